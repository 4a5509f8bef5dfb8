"""Registered queries: operators bound to tables, with the SQL that checks them."""
