import __spark_entry__ as entry


def test_entry_runs(spark):
    rows = entry.entry(spark).collect()
    assert rows and {"pii_type", "n", "docs"} <= set(rows[0].asDict())


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_queries_match_oracles(spark):
    import duckdb

    con = duckdb.connect()
    d = "/root/testdata/sf0.001"
    for t in ("documents", "conversations", "events", "customer", "supplier", "orders", "benchmark", "labels"):
        con.sql(f"create view {t} as select * from '{d}/{t}.parquet'")
    queries, oracles = entry.queries(), entry.oracle_sql()
    for name in ("q_email_spans", "q_card_detect_strict", "q_phone_detect", "q_redact_mask", "q_metrics_rollup", "q_rate_limit", "q_chat_tokenize", "q_chat_flow", "q_provider_counters", "q_anchor_windows", "q_anchored_detect", "q_redact_all_types", "q_token_redactor", "q_stream_joined", "q_name_heuristic"):
        df = queries[name](spark, d)
        cols = sorted(df.columns)
        got = sorted(map(repr, (tuple(r) for r in df.select(*cols).collect())))
        want = sorted(map(repr, con.sql(oracles[name]).project(",".join(f'"{c}"' for c in cols)).fetchall()))
        assert got == want, name
