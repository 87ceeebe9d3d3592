"""Job and session state over event tables and streams."""
