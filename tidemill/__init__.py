"""Tidemill: a durable event log, work queue and change stream expressed as Spark DataFrames."""
