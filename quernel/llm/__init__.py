"""Training-data operators: packing, mixing, PII, quality, dedup, tokens, licences, secrets.

Nothing outside this folder imports it; ``queries.py`` lists what it registers.
"""
