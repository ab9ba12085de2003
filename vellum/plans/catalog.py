"""All queries of the core library."""

from __future__ import annotations

from . import cleaning, conversations, corpus, gating, mining, records, relations, selection, statistics  # noqa: F401
from .registry import QUERIES, SQL, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


#: Columns that the other engine would give as wide integers or decimals, and their plain types.
PLAIN_TYPES = {
    "c26_edit_lists": "n_from bigint, n_to bigint", "r03_format_reward": "reward double", "s01_recursive_scan": "n_chars bigint", "s02_pruned_scan": "n_chars bigint",
    "s04_strided_groups": "ids bigint", "s11_books_of_pages": "n_chars bigint", "w01_balanced_shards": "n_chars bigint, ids bigint", "f05_period_gate_report": "n_chars bigint",
    "f23_length_gates": "n_200 bigint, n_1000 bigint, n_5000 bigint", "f27_topic_density": "n_hits bigint", "o01_union_all": "n_chars bigint",
    "a07_filter_what_if": "kept_98 bigint, kept_90 bigint, kept_80 bigint", "a09_rollup_report": "n_chars bigint", "a10_shard_balance": "min_chars bigint, max_chars bigint", "a20_compression": "n_bytes bigint",
}


def oracle_sql() -> dict[str, str]:
    out = dict(SQL)
    for name, columns in PLAIN_TYPES.items():
        casts = ", ".join(f"cast({c.split()[0]} as {c.split()[1]}) as {c.split()[0]}" for c in columns.split(", "))
        out[name] = f"select * replace ({casts}) from ({out[name]})"
    return out
