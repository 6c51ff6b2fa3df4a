"""Operators of a training-data pipeline over text documents; nothing outside this folder imports them."""
