"""Spark jobs over sonar survey tables: ingestion, geometry, scoring, association, reports and evaluation."""
