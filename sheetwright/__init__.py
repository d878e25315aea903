"""Spreadsheet-template extraction as Spark jobs over one long `cells` table."""
