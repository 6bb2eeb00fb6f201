from tidemark import cli


def test_commands_and_exit_codes(spark, sf, capsys, tmp_path):
    assert cli.main(["eval", "power", "--shares", "0.25", "0.05", "--tasks", "500"]) == 0
    assert cli.main(["eval", "power", "--shares", "0.21", "0.2", "--tasks", "50"]) == 1
    assert cli.main(["workers", "show", "--data", sf]) == 0 and "truncation_rate" in capsys.readouterr().out
    assert cli.main(["eval", "audit", "--data", sf]) == 1
    assert cli.main(["workers", "validate", "--data", sf]) == 1
    assert cli.main(["policy", "repair", "--data", sf]) in (0, 1)
    assert cli.main(["policy", "runs", "--root", str(tmp_path)]) == 0
    assert cli.main(["policy", "fixture", "--data", sf, "--out", f"{tmp_path}/synth"]) == 0
    assert spark.read.parquet(f"{tmp_path}/synth").count() == 2400


def test_every_command_names_a_query():
    from tidemark.plans import problem_queries, replay_queries, rollout_queries

    have = problem_queries.QUERIES | replay_queries.QUERIES | rollout_queries.QUERIES
    assert all(q in have for cs in cli.COMMANDS.values() for q in cs.values() if q)
