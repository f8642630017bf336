"""Registered queries against their SQL equivalents.

By default a sample of every family runs; TEST_ALL_QUERIES=1 runs them all."""
import os
import re
import subprocess
import sys


ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SAMPLE = """scan_examples jsonl_rejects cache_roundtrip load_report classify_convert preference_pairs next_action tool_selection letter_choice_parse
cap_per_task holdout_split oversample_rare eval_overlap length_buckets fixed_label_sets narrow_options pad_options json_state abstain_augment
rule_threshold rule_precedence state_twin twin_audit contrastive_valid pair_verify routing_keep render_question plan_rows prompt_text shared_prefix_units
format_answer combine_isolated second_reading beam_classify fit_temperature check_records eval_summary auroc run_compare paired_bootstrap latency_summary
discounted_return advantages score_centroid score_lexical""".split()


def test_registry_is_complete():
    import __spark_entry__ as E

    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q) and set(SAMPLE) <= set(q)
    own = {n for n in q if n != "pipeline" and not re.match(r"op\d+_", n)}
    assert own - set(o) == {"score_trained"}


def test_entry_runs(spark):
    import __spark_entry__ as E

    assert E.entry(spark).count() > 0


def test_against_sql(spark, sf):
    import duckdb

    import __spark_entry__ as E
    from tools.check import TABLES, compare

    names = [n for n in E.queries() if n in E.plans.load()[0]] if os.environ.get("TEST_ALL_QUERIES") else SAMPLE
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    bad = [(n, why) for n in names if (why := compare(spark, con, sf, n, E.queries()[n], E.oracle_sql().get(n)))]
    assert not bad, bad


def test_registers_from_another_process():
    out = subprocess.run([sys.executable, "-c", "import adjudica.plans as p; q, _ = p.load(); print(len(q))"], cwd=ROOT, capture_output=True, text=True)
    assert int(out.stdout.split()[-1]) > 180
