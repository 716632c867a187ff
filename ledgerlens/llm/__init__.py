"""Operators of a training-data pipeline: text in, decisions, shards, token ids and archives out."""
