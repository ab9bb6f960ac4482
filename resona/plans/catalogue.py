"""What the catalogue says about the given tables beyond their schemas."""

GIVEN_TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
    "embeddings", "pages", "benchmark", "labels", "conversations",
]

# (child table, child column, parent table, parent column)
GIVEN_REFERENCES = [
    ("nation", "n_regionkey", "region", "r_regionkey"),
    ("customer", "c_nationkey", "nation", "n_nationkey"),
    ("supplier", "s_nationkey", "nation", "n_nationkey"),
    ("orders", "o_custkey", "customer", "c_custkey"),
    ("lineitem", "l_orderkey", "orders", "o_orderkey"),
    ("lineitem", "l_partkey", "part", "p_partkey"),
    ("lineitem", "l_suppkey", "supplier", "s_suppkey"),
    ("labels", "doc_id", "documents", "doc_id"),
]

DESCRIPTIONS = {
    "orders": "read as videos of the star schema",
    "lineitem": "read as scored comments of the star schema",
    "events": "read as raw comments",
    "benchmark": "video descriptions",
}
