"""Diverse-subset selection and scoring on Spark."""
