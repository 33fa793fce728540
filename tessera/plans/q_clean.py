"""Cleaning queries over the ``dirty_orders`` and domain fixture views."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import clean as C
from tessera.operators.quality import dq_scores
from tessera.plans import sqlkit as S
from tessera.plans.catalog import register
from tessera.plans.policy import ORDERS_POLICY, compile_policy
from tessera.session import ensure_checkpoint_dir
from tessera.sources import fixtures as X

DO = X.DIRTY_ORDERS_SPEC


def _orders(spark, sf):
    return X.dirty_orders(spark, sf)


def _w(body: str, *names: str) -> str:
    return S.with_fixtures(list(names) or ["dirty_orders"], body)


# ------------------------------------------------------------- tool family
@register("noise_profiles", lambda: _w("SELECT * FROM dirty_orders"))
def noise_profiles(spark, sf):
    """The composed, seeded noise profile (missing, invalid tokens,
    duplicates, outliers, drift, junk in numerics) applied to orders."""
    return _orders(spark, sf)


@register("clean_drop_duplicates", lambda: _w(
    "SELECT min(_seq) AS _seq, order_id, customer_id, priority, price, order_date, status FROM dirty_orders "
    "GROUP BY ALL"))
def clean_drop_duplicates(spark, sf):
    return C.drop_duplicates(_orders(spark, sf))


@register("clean_replace_invalid_with_null", lambda: _w(
    f"SELECT _seq, {S.invalid_null('priority')} AS priority, {S.invalid_null('price')} AS price FROM dirty_orders"))
def clean_replace_invalid_with_null(spark, sf):
    df = C.replace_invalid_with_null(C.replace_invalid_with_null(_orders(spark, sf), "priority"), "price")
    return df.select("_seq", "priority", "price")


@register("clean_cast_numeric", lambda: _w(f"SELECT _seq, {S.parse_double('price')} AS price FROM dirty_orders"))
def clean_cast_numeric(spark, sf):
    return C.cast_numeric(_orders(spark, sf), "price").select("_seq", "price")


@register("clean_cast_datetime", lambda: _w(
    f"SELECT _seq, {S.to_datetime('order_date')} AS order_date FROM dirty_orders"))
def clean_cast_datetime(spark, sf):
    return C.cast_datetime(_orders(spark, sf), "order_date").select("_seq", "order_date")


_V = S.parse_double(S.invalid_null("price"))


@register("clean_impute_numeric_median", lambda: _w(
    f"SELECT _seq, coalesce({_V}, (SELECT quantile_cont({_V}, 0.5) FROM dirty_orders)) AS price FROM dirty_orders"))
def clean_impute_numeric_median(spark, sf):
    df = C.replace_invalid_with_null(_orders(spark, sf), "price")
    return C.impute_numeric(df, "price", "median").select("_seq", "price")


@register("clean_impute_numeric_mean", lambda: _w(
    f"SELECT _seq, coalesce({_V}, (SELECT avg({_V}) FROM dirty_orders)) AS price FROM dirty_orders"))
def clean_impute_numeric_mean(spark, sf):
    df = C.replace_invalid_with_null(_orders(spark, sf), "price")
    return C.impute_numeric(df, "price", "mean").select("_seq", "price")


@register("clean_impute_categorical", lambda: _w(
    f"SELECT _seq, coalesce(priority, {S.mode_of('priority', 'dirty_orders')}, 'unknown') AS priority "
    "FROM dirty_orders"))
def clean_impute_categorical(spark, sf):
    return C.impute_categorical(_orders(spark, sf), "priority").select("_seq", "priority")


@register("clean_normalize_categories", lambda: _w(
    f"SELECT _seq, {S.normalize('priority')} AS priority FROM dirty_orders"))
def clean_normalize_categories(spark, sf):
    return C.normalize_categories(_orders(spark, sf), "priority").select("_seq", "priority")


_PRICE = S.parse_double("price")
_QS = (f"(SELECT quantile_cont({_PRICE}, 0.25) AS q1, quantile_cont({_PRICE}, 0.75) AS q3 "
       f"FROM dirty_orders) b")


@register("clean_clip_outliers_iqr", lambda: _w(
    f"SELECT _seq, {S.clip(_PRICE, 'q1', 'q3')} AS price FROM dirty_orders, {_QS}"))
def clean_clip_outliers_iqr(spark, sf):
    return C.clip_outliers_iqr(_orders(spark, sf), "price").select("_seq", "price")


@register("clean_clip_report", lambda: _w(
    f"SELECT {S.sround('q1 - 1.5 * (q3 - q1)', 4)} AS lower, {S.sround('q3 + 1.5 * (q3 - q1)', 4)} AS upper, "
    f"CAST(count_if({_PRICE} < {S.iqr_bounds('q1', 'q3')[0]} OR {_PRICE} > {S.iqr_bounds('q1', 'q3')[1]}) AS BIGINT) AS n_clipped "
    f"FROM dirty_orders, {_QS} GROUP BY q1, q3"))
def clean_clip_report(spark, sf):
    return C.clip_report(_orders(spark, sf), "price")


def _policy_ctes() -> list[tuple[str, str]]:
    p0 = S.parse_double(S.invalid_null("price"))
    return [
        ("s0", f"SELECT _seq, order_id, customer_id, {S.normalize(S.invalid_null('priority'))} AS pri1, {p0} AS p0, "
               "order_date, status FROM dirty_orders"),
        ("s1", "SELECT s0.*, coalesce(p0, (SELECT quantile_cont(p0, 0.5) FROM s0)) AS p1 FROM s0"),
        ("b", "SELECT quantile_cont(p1, 0.25) AS q1, quantile_cont(p1, 0.75) AS q3 FROM s1"),
        ("s2", f"SELECT _seq, order_id, customer_id, coalesce(pri1, {S.mode_of('pri1', 's0')}, 'unknown') AS priority, "
               f"{S.clip('p1', 'q1', 'q3')} AS price, {S.to_datetime('order_date')} AS order_date, status FROM s1, b"),
        ("cleaned", "SELECT min(_seq) AS _seq, order_id, customer_id, priority, price, order_date, status "
                    "FROM s2 GROUP BY ALL"),
    ]


@register("clean_policy_orders", lambda: S.with_fixtures(["dirty_orders"], "SELECT * FROM cleaned", _policy_ctes()))
def clean_policy_orders(spark, sf):
    """The minimum slice: token->null, cast, median impute, IQR clip,
    normalise, mode impute, date cast, dedup -- one projection + 2 stat levels."""
    return compile_policy(_orders(spark, sf), ORDERS_POLICY)


def _summary_sql() -> str:
    dq_before = S.dq_select("dirty_orders", DO["columns"], DO["numeric"], {"order_id"})
    dq_after = S.dq_select("cleaned", DO["columns"], DO["numeric"], {"order_id", "price"})
    ctes = _policy_ctes() + [("before", dq_before), ("after", dq_after)]
    body = (f"SELECT priority, count(*) AS n_orders, {S.sround('avg(price)', 4)} AS avg_price, "
            f"{S.sround('sum(price)', 2)} AS total_price, (SELECT overall FROM before) AS dq_before, "
            "(SELECT overall FROM after) AS dq_after FROM cleaned GROUP BY priority")
    return S.with_fixtures(["dirty_orders"], body, ctes)


@register("clean_orders_summary", _summary_sql)
def clean_orders_summary(spark, sf):
    """Flagship: clean the dirty orders, aggregate price by priority, and
    report the table's DQ score before and after cleaning (two one-row
    aggregates, inlined as literals)."""
    ensure_checkpoint_dir(spark)
    raw = _orders(spark, sf)
    # the cleaned (silver) table feeds two aggregates: materialize it once in
    # the shared checkpoint folder instead of recomputing the cleaning plan
    cleaned = compile_policy(raw, ORDERS_POLICY).checkpoint(eager=True)
    before = dq_scores(raw, DO["columns"], DO["numeric"]).first()["overall"]
    after = dq_scores(cleaned, DO["columns"], DO["numeric"]).first()["overall"]
    return cleaned.groupBy("priority").agg(
        F.count(F.lit(1)).alias("n_orders"), F.round(F.avg("price"), 4).alias("avg_price"),
        F.round(F.sum("price"), 2).alias("total_price"),
        F.lit(before).cast("double").alias("dq_before"), F.lit(after).cast("double").alias("dq_after"))
