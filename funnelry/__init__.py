"""Conversion-funnel analytics over clickstream event tables, as Spark DataFrame operators."""
