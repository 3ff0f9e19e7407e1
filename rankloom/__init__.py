"""Retrieval, fusion and evaluation over whole tables of questions, as Spark plans."""
