"""Sources and sinks: text files, dictionary CSV, tables, reports."""
