"""Writers of tables, reports and archives."""
