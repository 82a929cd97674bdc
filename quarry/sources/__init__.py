"""Sources and sinks: folders, uploads, archives and workspaces."""
