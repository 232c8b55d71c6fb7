import json
import os

from pyspark.sql import functions as F

from spanloom.sources import runs


def test_candidates(spark):
    cases = [
        ({}, {"clip_id": "interval_0_0.000_0.000", "editorial_family": "unknown", "score": 0.0, "favorability_score": None, "coice_score": None, "context_gate": False, "review_required": False}),
        ({"start": 9, "end": "4.5", "score": 120, "family": " Hook "}, {"clip_id": "interval_1_4.500_9.000", "start": 4.5, "end": 9.0, "duration": 4.5, "score": 100.0, "editorial_family": "hook"}),
        ({"clip_id": " a  b ", "start_time": 1, "end_time": 3, "duration": -1, "favorability": {"signal": 61.23456}, "coice": True}, {"clip_id": "a b", "duration": 2.0, "favorability_score": 61.235, "coice_signal": True, "coice_score": None}),
        ({"counterpunch": {"signal": 7, "available": 1, "answer_complete": "sim"}, "technical_gate": {"status": "weak", "payoff_gate": "on"}, "context_quality": 60}, {"coice_signal": True, "coice_score": 7.0, "review_required": True, "payoff_gate": True, "context_gate": True}),
        ({"factors": {"completeness": 80, "context_gate": False, "editorial_family": "X"}, "quality_scorecard": {"status": "review", "context_quality": 3}, "acervo_context": {"seed_only": "yes"}}, {"context_quality": 80.0, "context_gate": False, "editorial_family": "x", "review_required": True, "from_acervo_seed": True}),
        ({"editorial_key": "k", "total_score": "nan", "favorability_score": -4, "signal": 50, "start": -3, "end": "x"}, {"clip_id": "k", "score": 0.0, "favorability_score": 0.0, "coice_score": 50.0, "start": 0.0, "end": 0.0, "duration": 3.0}),
        ([1], {"clip_id": "interval_6_0.000_0.000"}), (None, {"clip_id": "interval_7_0.000_0.000", "timing_gate": False}),
    ]
    rows = spark.createDataFrame([(i, json.dumps(c[0])) for i, c in enumerate(cases)], "i int, raw string")
    out = rows.select("i", runs.candidate(F.try_parse_json("raw"), F.col("i")).alias("c")).orderBy("i").collect()
    for (value, want), row in zip(cases, out):
        assert {k: row["c"][k] for k in want} == want, value
        assert tuple(row["c"].asDict()) == runs.COLUMNS


def test_runs_written_and_read(spark, tmp_path):
    made = spark.createDataFrame([(f"run {i % 2}", i, json.dumps({"clip_id": f"c{i}", "start": i, "end": i + 5, "review_required": i % 3 == 0})) for i in range(10)], "run_id string, i int, raw string")
    made = made.select("run_id", F.lit("s").alias("source_id"), F.lit("off").alias("mode"), F.lit("x").alias("backend"), F.lit(True).alias("seeds_enabled"), F.lit("2026").alias("generated_at"), runs.candidate(F.try_parse_json("raw"), F.col("i")).alias("candidate"))
    folder = str(tmp_path / "runs")
    runs.write_runs(made, folder)
    kept, rejected = runs.read_runs(spark, folder)
    flat = lambda df: sorted(map(str, df.select("run_id", "source_id", "seeds_enabled", "candidate").collect()))
    assert flat(kept) == flat(made.withColumn("run_id", runs.run_id(F.col("run_id")))) and rejected.count() == 0
    assert runs.read_runs(spark, folder, "run_1")[0].count() == 5
    assert {tuple(r) for r in runs.run_counts(kept).collect()} == {("run_0", 5, 2, 0), ("run_1", 5, 2, 0)}
    with open(f"{folder}/run=run_0/more.json", "w") as more:
        more.write('{"schema": "candidate-run.v1", "run_id": "run_0"\n{"schema": "other", "candidate": {"clip_id": "x"}}\n{"schema": "candidate-run.v1", "candidate": null}\n')
    kept, rejected = runs.read_runs(spark, folder)
    assert kept.count() == 10 and sorted((r["run"], r["reason"]) for r in rejected.collect()) == [("run_0", "candidate"), ("run_0", "corrupt"), ("run_0", "schema")]
    runs.write_runs(made.filter("run_id = 'run 0'").limit(1), folder)  # replaces one run only
    assert {r["run_id"]: r["candidates_n"] for r in runs.run_counts(runs.read_runs(spark, folder)[0]).collect()} == {"run_0": 1, "run_1": 5}
    runs.write_table(made, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).columns == [*runs.COLUMNS, "run"] and len(os.listdir(tmp_path / "csv")) >= 2
