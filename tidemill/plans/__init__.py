"""Whole-table query plans and the SQL that states what each must return."""
