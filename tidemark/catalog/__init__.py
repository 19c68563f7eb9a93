"""Tables of datasets, files, techniques, dependencies, profiles and destinations."""
