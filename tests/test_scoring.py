"""Golden values for rewards, labeling functions, personas and parsers."""

from pyspark.sql import functions as F

from tessera.functions import constants as K
from tessera.operators import actions as A
from tessera.operators import answers as AN
from tessera.operators import weak as W


def test_reward_formulas(spark):
    # step reward: max(-0.15, delta - 0.02); gate bonus; final reward
    df = spark.createDataFrame([(0.5, 0.7), (0.9, 0.1)], "before double, after double")
    r = [x[0] for x in df.select(F.greatest(F.lit(K.STEP_MAX_NEGATIVE),
                                            F.col("after") - F.col("before") - K.STEP_IMPROVEMENT_MARGIN)).collect()]
    assert abs(r[0] - 0.18) < 1e-12 and r[1] == -0.15
    final = 0.45 * 1.0 + 0.30 * 1.0 + 0.25 * 1.0
    assert final == 1.0


def test_majority_vote(spark):
    rows = [(1, 1, 0), (0, 0, 1), (1, 0, -1), (-1, -1, -1)]
    df = spark.createDataFrame(rows, "a int, b int, c int")
    got = [r[0] for r in df.select(W.majority_vote([F.col("a"), F.col("b"), F.col("c")])).collect()]
    assert got == [1, 0, -1, -1]


def test_hr_lfs(spark):
    df = spark.createDataFrame([(500.0, 17, 0, -1, 1, 80), (5000.0, 30, 3, 5, 2, 80)],
                               "MonthlyIncome double, Age long, JobSatisfaction long, YearsAtCompany long, "
                               "EmployeeCount int, StandardHours int")
    r = W.Row(df)
    got = df.select(W.lf_hr_salary_range(r), W.lf_hr_age_range(r), W.lf_hr_satisfaction_range(r),
                    W.lf_hr_years_nonnegative(r), W.lf_hr_constant_columns(r)).collect()
    assert tuple(got[0]) == (0, 0, 0, 0, -1)
    assert tuple(got[1]) == (1, 1, 1, 1, 0)


def test_persona_alignment(spark):
    text = "Revenue growth this quarter beat the budget by 5 percent; ROI and margin trend up with low risk."
    df = spark.createDataFrame([(text,)], "t string")
    got = df.select(AN.alignment(F.col("t"), AN.PERSONA_BY_ROLE["executive"])).first()[0]
    # 8 keyword hits / 3.3 -> 1.0; formality: 'percent' + 'quarter' -> 1.0; no anti words
    assert got == 1.0


def test_parsers_golden(spark):
    rows = ['{"operation": "fill_null", "column": "Age", "value": "median"}',
            'Please remove duplicate rows now',
            'I will trim whitespace in "Department"',
            'no idea']
    df = spark.createDataFrame([(t,) for t in rows], "t string")
    p = df.select(A.parse_cleaning_action(F.col("t")).alias("p")).select("p.*").collect()
    assert (p[0]["operation"], p[0]["column"], p[0]["parsed_from"]) == ("fill_null", "Age", "json")
    assert (p[1]["operation"], p[1]["column"]) == ("remove_duplicate", "")
    assert (p[2]["operation"], p[2]["column"]) == ("trim", "Department")
    assert (p[3]["operation"], p[3]["column"], p[3]["value"]) == ("fill_null", "", "median")
    f = [r[0] for r in df.select(A.fmt_cleaning(F.col("t"))).collect()]
    assert f == [1.0, 0.0, 0.0, 0.0]


def test_tool_parser_and_format(spark):
    rows = ['{"tool": "run_quality_gates"}', '{"tool": "apply_cleaning_operation", "arguments": '
            '{"operation": "cast_numeric", "column": "age"}}', 'let me profile the data', '{"tool": 1']
    df = spark.createDataFrame([(t,) for t in rows], "t string")
    p = df.select(A.parse_tool_action(F.col("t")).alias("p")).select("p.tool", "p.parsed_from").collect()
    assert p[0]["tool"] == "run_quality_gates" and p[0]["parsed_from"] == "json"
    assert p[2]["tool"] == "profile_data"
    f = [r[0] for r in df.select(A.fmt_tool(F.col("t"))).collect()]
    assert f == [1.0, 0.0, 0.0, 0.0]
