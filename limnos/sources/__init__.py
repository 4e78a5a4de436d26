"""Sources and sinks: table loaders, test-table bindings, files, live feeds."""
