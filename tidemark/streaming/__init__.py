"""The replay as a stream, once its plan is fixed."""
