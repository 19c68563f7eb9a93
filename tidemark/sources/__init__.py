"""Files to records: ``file_path, file_name, format, raw, data`` with ``data map<string,variant>``."""
