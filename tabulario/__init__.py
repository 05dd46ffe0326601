"""Tabulario: diagnosis and business analysis of tables, written as Spark DataFrame operators."""
