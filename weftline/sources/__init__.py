"""Sources: binary layouts, text formats, generators and fixture views."""
