from sparkloom.streaming import boundaries

MINUTE = 60_000_000


def test_windows_that_share_little_are_a_boundary():
    events = [(k, k * MINUTE, t) for k, t in enumerate("aaaab" + "bcccc" + "ccccc")]
    assert boundaries.step(events, [], [], None)[0] == [(10, "context_shift", 0.7)]
    (at, reason, confidence), *rest = boundaries.step(events, [], [], None, boundaries.window_similarity)[0]
    assert (at, reason, round(confidence, 6)) == (9, "similarity_drop", round(1 - 1 / 17, 6)) and not rest
    assert boundaries.window_similarity(["a", None], ["a"]) == 1.0 and boundaries.window_similarity([None], []) == 1.0


def test_similar_boundary_stream_equals_the_rule(spark, data):
    found = boundaries.episode_boundaries(spark, f"{data}/events.parquet", by_similarity=True, about="event_type").collect()
    rows = spark.read.parquet(f"{data}/events.parquet").selectExpr("user_id", "event_id", "unix_micros(cast(ts as timestamp)) as us", "event_type").collect()
    by = {}
    for r in sorted(rows, key=lambda r: (r["us"], r["event_id"])):
        by.setdefault(r["user_id"], []).append((r["event_id"], r["us"], r["event_type"]))
    want = sorted((u, e, why) for u, es in by.items() for e, why, _ in boundaries.step(es, [], [], None, boundaries.window_similarity)[0])
    assert sorted((r["user_id"], r["event_id"], r["reason"]) for r in found) == want
