"""Operators of a training-data pipeline: line dedup, decontamination, WARC
salvage, packing, sharding, language-model scoring, repeated-passage removal,
licence scans, near-duplicate detection, quality rules, vector codes, exact
dedup and fill-in-middle.

Nothing else in the library imports this subpackage. Each module holds one
operator; ``queries`` registers them and ``oracle`` holds their DuckDB SQL.
"""
