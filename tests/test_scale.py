"""Steps whose tables are small next to what they give: their results come out of many tasks, with nothing large sorted."""

from pyspark.sql import functions as F

from conftest import SF_SMALL
from probitas.operators import questionnaire as Q
from probitas.operators import samples as SM
from probitas.sources import io as IO


def _units(spark, n=200):
    return spark.range(n).selectExpr("element_at(array('language_scenario', 'country_scenario'), cast(id % 2 as int) + 1) AS scenario",
                                     "concat('k', id) AS unit_key", "cast(id as int) AS country_ord", "0 AS lang_pos",
                                     "concat('C', id) AS country", "'Dutch' AS language")


def _base(spark):
    return spark.createDataFrame([(1, "Fact", "Is IT so?"), (1, "Fact", "Is it?"), (1, "Support", "Good?"), (1, "Opposition", None),
                                  (None, "Fact", "Whose?"), (2, "Other", "Lost")], "criterion_id int, question_type string, text string")


def _prompts(spark):
    return spark.createDataFrame([("English", 'Say "yes" or "no".', "ok"), ("Dutch", 'Zeg "ja" of "nee".', "ok")],
                                 "language string, prompt string, status string")


def _parts(df):
    return df.withColumn("_part", F.spark_partition_id()).select("_part").distinct().count()


def _most(spark):
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_questionnaire_comes_out_of_all_parts(spark):
    q = Q.build_questionnaire(_units(spark), _base(spark))
    assert _parts(q) == _most(spark)
    above = q._jdf.queryExecution().executedPlan().toString().split("BroadcastNestedLoopJoin")[0]
    assert "Exchange" not in above and "Sort" not in above and "Aggregate" not in above
    rows = {(r.unit_key, r.criterion_id): (r.fact, r.support, r.opposition) for r in q.where("unit_key in ('k4', 'k5')").collect()}
    assert rows == {("k4", 1): ("is it?", "good?", None), ("k4", None): ("whose?", None, None), ("k4", 2): (None, None, None),
                    ("k5", 1): ("In C5, is it?", "In C5, good?", None), ("k5", None): ("In C5, whose?", None, None), ("k5", 2): (None, None, None)}


def test_question_files_come_out_of_all_parts_unsorted(spark, tmp_path):
    q = Q.build_questionnaire(_units(spark, 40), _base(spark))
    IO.write_questionnaires(q, str(tmp_path))
    files = list(tmp_path.glob("*/*/*.csv"))
    assert len({f.parent for f in files}) == len(files) == 40 and len({f.name.split("-")[1] for f in files}) == _most(spark)
    assert sorted(map(repr, IO.scan_questionnaires(spark, str(tmp_path)).collect())) == sorted(map(repr, q.collect()))
    ordered = q.sortWithinPartitions("scenario", "unit_key")  # as a sink with a folder for each wants it: so they come already
    assert "Sort" not in ordered._jdf.queryExecution().executedPlan().toString().split("BroadcastNestedLoopJoin")[0]


def test_prompts_stay_where_their_units_are(spark):
    prompts = Q.build_prompts(Q.build_questionnaire(_units(spark), _base(spark)), _units(spark), _prompts(spark))
    assert _parts(prompts) == _most(spark) and prompts.count() == 200 * 3
    plan = prompts._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan
    product = plan.split("ShuffledHashJoin")[1].split("BroadcastNestedLoopJoin")[0]
    assert "Exchange" not in product  # the questions are not moved to meet their units


def test_first_round_is_asked_in_several_tasks(spark):
    def where(batches):
        from pyspark import TaskContext
        for pdf in batches:
            yield pdf.assign(response=f"yes {TaskContext.get().partitionId()}")

    questions = Q.build_prompts(Q.build_questionnaire(_units(spark), _base(spark)), _units(spark), _prompts(spark)).withColumn("model", F.lit("m")).where("criterion_id = 1")
    got = SM.collect_samples(questions, where, n=2, max_attempts=4).collect()
    assert len(got) == 200 * 2 * 2 and {r.status for r in got} == {"complete"} and all(r.full_prompt for r in got)
    assert len({r.response for r in got}) > 1


def test_answer_cells_are_sorted_by_one_number(spark):
    from probitas.sources import driver_tables as D
    plan = D.item_scores(spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    lowest = [line for line in plan.splitlines() if "Aggregate(key=[" in line and "l_orderkey" in line][-1]
    assert "," not in lowest.split("key=[")[1].split("]")[0]


def test_answer_cells_with_repeated_rows_and_nulls(spark, tmp_path):
    from probitas.sources import driver_tables as D
    schema = "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_discount double, l_tax double, l_quantity double"
    rows = [(7 * k, line, part, 5, 0.05, tax, 10.0) for k in (1, 8) for line in (1, 2, 3) for part in (3, 23) for tax in (0.0, 0.04, None)]
    rows += [rows[0], rows[-1], (7, None, 3, 5, 0.01, 0.02, 5.0), (7, 1, None, 5, 0.01, 0.02, 5.0), (7, 1, 3, None, 0.01, 0.02, 5.0)]
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.range(60).write.parquet(f"{tmp_path}/supplier.parquet")
    got = D.item_scores(spark, str(tmp_path)).collect()
    keys = [(r.scenario, r.model, r.unit_key, r.criterion_id) for r in got]
    assert len(set(keys)) == len(keys) and len({k[0] for k in keys}) >= 3
    code = D.LANGUAGE_CODES[56 % len(D.LANGUAGE_CODES)]
    assert [r.support for r in got if (r.scenario, r.model, r.unit_key, r.criterion_id) ==
            (D.R.SCENARIO_LANGUAGE, D.TEST_MODELS[0], code, 3)] == [0.04 / 0.08]  # of order 56 the greatest row: part 23, tax 0.04
