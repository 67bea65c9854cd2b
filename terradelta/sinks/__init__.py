"""Where results go: vector files, pictures, the viewer and the record of a run."""
