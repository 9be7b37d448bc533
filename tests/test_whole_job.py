"""Queries that take the whole table, where others are held to the ids that their SQL names."""

import pytest

from tidemark.catalog import QUERIES
from tidemark.operators import leaderboard, qa


@pytest.mark.parametrize("name", ["vector_topk_all", "vector_threshold_all", "persona_best_match_all", "persona_topk_all"])
def test_vector_queries_grow_with_the_table_and_find_any_row(spark, tmp_path, name):
    v = [(i, [1.0, i / 1000]) for i in range(0, 2501)]
    v[7] = (7, [-1.0, 0.0])
    v[2500] = (2500, [-1.0, -0.001])  # its nearest row is 7, an id under 20
    spark.createDataFrame(v, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = QUERIES[name](spark, str(tmp_path)).collect()
    assert {r["query_id"] for r in got} == set(range(0, 2501, 100))
    assert [r["vec_id"] for r in got if r["query_id"] == 2500 and r.asDict().get("rank", 1) == 1] == [7]
    assert not [r for r in got if r["query_id"] == r["vec_id"]]


def test_every_document_is_judged_against_the_next_segment(spark, tmp_path):
    texts = [(1, "Anna"), (2, "Berta"), (3, "Anna"), (4, "Berta"), (5, "Clara"), (6, "Clara"), (7, "Dora"), (8, None)]
    spark.createDataFrame([(i, t, "en", "src1") for i, t in texts], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["qa_id"] for r in QUERIES["entity_overlap_discard_all"](spark, str(tmp_path)).collect()}
    assert got == {1, 2, 3, 4, 6, 7, 8}  # 5 is of segment 1 and 6, of segment 2, has Clara too
    stamped = QUERIES["inherit_stamp_all"](spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in stamped} == set(range(1, 9))


def test_availability_counts_all_events(spark, tmp_path):
    events = [(i, "a" if i % 4 else "b", i) for i in range(1, 41)]
    spark.createDataFrame(events, "event_id long, event_type string, user_id long").write.parquet(f"{tmp_path}/events.parquet")
    plan = {r["topic"]: (r["target"], r["available"], r["inherit"], r["generate"]) for r in QUERIES["inherit_plan_all"](spark, str(tmp_path)).collect()}
    assert plan == {"a": (375, 30, 30, 345), "b": (125, 10, 10, 115)}
    assert QUERIES["inherit_summary_all"](spark, str(tmp_path)).first().asDict() == {"inherit_count": 40, "discarded": 960, "candidate_count": 40, "generation_needed": 460}
    assert QUERIES["remaining_target_all"](spark, str(tmp_path)).first()["remaining"] == 460
    assert {r["topic"] for r in QUERIES["budgeted_resample_all"](spark, str(tmp_path)).collect()} == {"a", "b"}


def test_next_answer_over_blocks_and_without_one_window_a_conversation(spark):
    turns = [(1, t, "user" if t % 2 == 1 else "assistant", f"t{t}") for t in range(1000) if not 300 <= t < 900] + [(2, 5, "user", "q"), (2, 5000, "assistant", "a")]
    got = qa.next_answer(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))
    wanted = [(1, t, f"t{t}", f"t{900 if t == 299 else t + 1}") for t in range(1, 999, 2) if not 300 <= t < 900]
    assert sorted(map(tuple, got.collect())) == sorted([*wanted, (2, 5, "q", "a")])
    assert "_block" in got._jdf.queryExecution().toString()


def test_a_long_board_is_ranked_in_parts(spark):
    rows = [(i, f"s{i}", None if i % 97 == 0 else float("nan") if i % 89 == 0 else float(i * 7 % 50)) for i in range(1, 2001)]
    got = leaderboard.ranked(spark.createDataFrame(rows, "seq long, system_name string, total_score double"))
    order = sorted(rows, key=lambda r: (r[2] is None, r[2] == r[2], -r[2] if r[2] is not None and r[2] == r[2] else 0, r[0]))
    assert {r["seq"]: r["rank"] for r in got.collect()} == {r[0]: k + 1 for k, r in enumerate(order)}
    assert "_part" in got._jdf.queryExecution().toString()
