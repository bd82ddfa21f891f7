"""Where results are kept: tables that change by whole actions."""
