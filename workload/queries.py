"""The registered queries: name -> (spark, sf_dir) -> DataFrame.

Double results are rounded so that engines that sum in different orders agree.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from creditloom.functions import (
    code_to_int, coalesce_key, days_to_years, flag, like_flag, ratio, sum_flags,
)
from creditloom.operators import cleaning, joins, projection, quality, reports, sketches
from creditloom.operators.quantiles import exact_percentile
from creditloom.plans import (
    application as a, bureau as b, cleaned, documented as k, exploration as j, gold as g,
    medallion, previous as p,
)
from creditloom.schemas import BUREAU, struct
from creditloom.session import scratch_path
from creditloom.sources import layers, manifest, quarantine
from creditloom.sources.checksums import checksums
from workload import roles

Query = Callable[[SparkSession, str], DataFrame]
NUMERIC = ["AMT_INCOME_TOTAL", "AMT_CREDIT", "AMT_ANNUITY", "AMT_GOODS_PRICE", "CNT_FAM_MEMBERS",
           "EXT_SOURCE_1", "EXT_SOURCE_3", "DAYS_EMPLOYED", "DAYS_LAST_PHONE_CHANGE"]
STRINGS = ["NAME_CONTRACT_TYPE", "FLAG_OWN_CAR", "OCCUPATION_TYPE", "NAME_TYPE_SUITE"]


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    """Round every double column."""
    return df.select([F.round(c, digits).alias(c) if t == "double" else F.col(c)
                      for c, t in df.dtypes])


def _history(spark, sf, *names):
    return [roles.HISTORY[n](spark, sf) for n in names]


# ---- feature tables ---------------------------------------------------------
def bureau_features(spark, sf):
    return rounded(b.bureau_features(*_history(spark, sf, "bureau", "bureau_balance")))


def bureau_features_per_loan(spark, sf):
    return rounded(b.bureau_features(*_history(spark, sf, "bureau", "bureau_balance"), "intended"))


def _previous_inputs(spark, sf):
    return _history(spark, sf, "previous_application", "POS_CASH_balance", "installments_payments",
                    "credit_card_balance")


def previous_union_merge(spark, sf):
    return rounded(p.previous_features(*_previous_inputs(spark, sf), form="union"), 6)


def previous_full_outer(spark, sf):
    return rounded(p.previous_features(*_previous_inputs(spark, sf), form="join"), 6)


def _train(spark, sf):
    return a.application_features(roles.application_train(spark, sf), True, "median")


def _test(spark, sf):
    return a.application_features(roles.application_test(spark, sf), False, "median")


def _splits(spark, sf):
    return _train(spark, sf), _test(spark, sf)


def gold(spark, sf):
    applications = a.application_features_of_splits(roles.labelled_splits(spark, sf), "unlabelled", "median")
    return rounded(g.gold_in_one_plan(applications, roles.raw(spark, sf)))


def gold_bucketed(spark, sf):
    """Gold of silver tables bucketed by loan, copied before they are dropped."""
    path = scratch_path(spark, "silver")
    db = "check_" + path.rsplit("-", 1)[-1]
    train, test = _splits(spark, sf)
    tables = {"application_train": train, "application_test": test,
              "bureau_features": b.bureau_features(*_history(spark, sf, "bureau", "bureau_balance")),
              "previous_features": p.previous_features(*_previous_inputs(spark, sf))}
    try:
        medallion.bucket_silver(tables, db, 8, path)
        return layers.stage_write(rounded(medallion.gold_of_buckets(spark, db)), scratch_path(spark, "gold"))
    finally:
        spark.sql(f"DROP DATABASE IF EXISTS {db} CASCADE")


def gold_layered(spark, sf):
    previous = p.previous_features(*_previous_inputs(spark, sf))
    bureau = b.bureau_features(*_history(spark, sf, "bureau", "bureau_balance"))
    return rounded(g.gold(*_splits(spark, sf), bureau, previous))


def _cleaned(name: str, mostly_unique: bool = False) -> Query:
    def run(spark, sf):
        return cleaned.clean_table(roles.HISTORY[name](spark, sf), name, partial=True, mostly_unique=mostly_unique)
    return run


def bureau_credit(spark, sf):
    return rounded(b.bureau_credit_features(_cleaned("bureau")(spark, sf)))


def delinquency(spark, sf):
    return rounded(b.bureau_delinquency_features(_cleaned("bureau")(spark, sf),
                                                 _cleaned("bureau_balance")(spark, sf)), 6)


def _integrated(split: str) -> Query:
    def run(spark, sf):
        source = roles.application_train if split == "train" else roles.application_test
        base = a.application_clean(source(spark, sf), "median")
        return rounded(g.integrate(base, g.integrated_features(roles.raw(spark, sf), partial=True)))
    return run


# ---- cleaning ---------------------------------------------------------------
def _imputed(strategy: str, rel_err: float = 0.01) -> Query:
    def run(spark, sf):
        app = roles.application(spark, sf).select("SK_ID_CURR", *NUMERIC)
        return rounded(cleaning.impute_numeric(app, NUMERIC, strategy, rel_err), 6)
    return run


def approx_median_bound(spark, sf):
    """Whether the rank of each approximate median is within the error asked for."""
    app = roles.application(spark, sf).select(NUMERIC)
    return _within(app, cleaning.fit_numeric(app, NUMERIC))


def sketch_refit(spark, sf):
    """Medians from sketches that were made per kind of contract and of car owner, stored, and merged."""
    app, path = roles.application(spark, sf), scratch_path(spark, "sketches")
    for day, part in enumerate(("FLAG_OWN_REALTY = 'Y'", "FLAG_OWN_REALTY = 'N'")):
        layers.write_layer(sketches.fit_sketches(app.where(part), NUMERIC, by=["REGION_RATING_CLIENT"]), f"{path}/{day}")
    stored = layers.read_layer(spark, path, "0").unionByName(layers.read_layer(spark, path, "1"))
    return _within(app.select(NUMERIC), sketches.sketch_quantiles(sketches.merge_sketches(stored)))


def _within(app: DataFrame, fills: DataFrame) -> DataFrame:
    values = app.select([F.col(c).cast("double") for c in NUMERIC]).unpivot([], NUMERIC, "column", "v")
    counts = values.where("v IS NOT NULL").join(fills, "column").groupBy("column").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("v") < F.col("fill")).alias("below"),
        F.count_if(F.col("v") <= F.col("fill")).alias("upto"))
    return counts.select("column", "n", ((F.col("below") <= 0.51 * F.col("n"))
                                         & (F.col("upto") >= 0.49 * F.col("n"))).alias("within"))


def median_per_loan(spark, sf):
    """Median order amount per customer: as many groups as customers."""
    bureau = roles.bureau(spark, sf)
    return rounded(exact_percentile(bureau, ["SK_ID_CURR"], "AMT_CREDIT_SUM", 0.5, "median_credit"))


def impute_mode_of_many(spark, sf):
    """Modes from sketched candidates; the long names are unique and are counted in full."""
    app = roles.application(spark, sf)
    return cleaning.apply_fills(app.select("SK_ID_CURR", *STRINGS), STRINGS,
                                sketches.fit_mode_of_many(app, STRINGS), "string")


def footer_count(spark, sf):
    """Rows of the lines and orders as their files' footers tell."""
    counts = [layers.footer_count(spark, f"{sf.rstrip('/')}/{n}.parquet").withColumn("source", F.lit(n)) for n in ("lineitem", "orders")]
    return counts[0].unionByName(counts[1])


def impute_mode(spark, sf):
    app = roles.application(spark, sf).select("SK_ID_CURR", *STRINGS)
    return cleaning.impute_mode(app, STRINGS)


def dedup_by_key(spark, sf):
    lines = roles.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_shipdate", "l_quantity", "l_extendedprice", "l_partkey")
    return cleaning.dedup_by_key(lines, ["l_orderkey", "l_linenumber"],
                                 ["l_shipdate", "l_quantity", "l_extendedprice", "l_partkey"])


# ---- joins ------------------------------------------------------------------
def join_detail(spark, sf):
    bureau, balance = _history(spark, sf, "bureau", "bureau_balance")
    records = bureau.select("SK_ID_CURR", "SK_ID_BUREAU", "CREDIT_ACTIVE")
    return joins.join_detail(records, balance, "SK_ID_BUREAU")


def cardinality_check(spark, sf):
    base = roles.application(spark, sf).select("SK_ID_CURR", "TARGET")
    features = b.bureau_credit_features(_cleaned("bureau")(spark, sf))
    return joins.cardinality_check(base, joins.fan_in(base, [features], "SK_ID_CURR"), "SK_ID_CURR")


# ---- quality ----------------------------------------------------------------
def _suite():
    return [quality.expect_not_null("SK_ID_CURR"), quality.expect_unique("SK_ID_CURR"),
            quality.expect_in_set("TARGET", [0, 1]), quality.expect_between("AGE_YEARS", 18, 100)]


def _validation_input(spark, sf):
    return roles.application(spark, sf).select(
        "SK_ID_CURR", "TARGET", days_to_years("DAYS_BIRTH", digits=2).alias("AGE_YEARS"))


def validate_suite(spark, sf):
    return quality.validate(_validation_input(spark, sf), _suite())


SUITE_JSON = """{"expectations": [
  {"expectation_type": "expect_column_values_to_not_be_null", "kwargs": {"column": "SK_ID_CURR"}},
  {"expectation_type": "expect_column_values_to_be_unique", "kwargs": {"column": "SK_ID_CURR"}},
  {"expectation_type": "expect_column_values_to_be_in_set", "kwargs": {"column": "TARGET", "value_set": [0, 1]}},
  {"expectation_type": "expect_column_values_to_be_between",
   "kwargs": {"column": "AGE_YEARS", "min_value": 18, "max_value": 100}}]}"""


def validate_loaded_suite(spark, sf):
    return quality.validate(_validation_input(spark, sf), quality.load_suite(SUITE_JSON))


def validate_failing(spark, sf):
    """Order lines break every expectation: NULL and repeated keys, odd labels, wide range."""
    lines = roles.table(spark, sf, "lineitem").selectExpr(
        "NULLIF(l_orderkey, 0) AS SK_ID_CURR", "l_linenumber AS TARGET", "l_quantity AS AGE_YEARS")
    return quality.validate(lines, _suite())


def key_audit(spark, sf):
    lines = roles.table(spark, sf, "lineitem").selectExpr("NULLIF(l_orderkey, 0) AS k")
    return quality.key_audit(lines, "k")


def promote(spark, sf):
    path = scratch_path(spark, "promote")
    return quality.promote(_validation_input(spark, sf), _suite(), f"{path}/final", f"{path}/staged")


# ---- sources and sinks ------------------------------------------------------
def csv_roundtrip(spark, sf):
    path = scratch_path(spark, "csv")
    layers.export_csv(roles.bureau(spark, sf), path)
    return layers.read_raw(spark, path, BUREAU)


def layer_roundtrip(spark, sf):
    layer = scratch_path(spark, "layer")
    layers.write_layer(roles.credit_card_balance(spark, sf), f"{layer}/card", rebalance=True)
    return rounded(p.card_risk(layers.read_layer(spark, layer, "card")), 6)


def _published(spark, sf, use, **options):
    """What ``use`` returns for a table published for the moment; nothing of it stays."""
    path = scratch_path(spark, "publish")
    db = "check_" + path.rsplit("-", 1)[-1]
    layers.publish_table(roles.bureau(spark, sf), db, "bureau", location=path, **options)
    try:
        return use(f"{db}.bureau")
    finally:
        spark.sql(f"DROP DATABASE {db} CASCADE")


def publish_verify(spark, sf):
    n = _published(spark, sf, lambda t: layers.verify_count(spark, t).first().n)
    return spark.createDataFrame([(n,)], "n long")


def published_content(spark, sf):
    """The rows of a bucketed table, copied before it is dropped."""
    copy = scratch_path(spark, "published")
    return _published(spark, sf, lambda t: layers.stage_write(spark.table(t), copy), bucket_by=(4, "SK_ID_BUREAU"))


def published_versions(spark, sf):
    """Three versions of a table: readers see the last one, the one before stays, older ones are gone."""
    path = scratch_path(spark, "versions")
    db = "check_" + path.rsplit("-", 1)[-1]
    bureau = roles.bureau(spark, sf)
    try:
        for status in ("Sold", "Closed", "Active"):
            layers.publish_table(bureau.where(F.col("CREDIT_ACTIVE") == status), db, "bureau", location=path)
        stored = layers.versions(spark, db, "bureau")
        seen = spark.table(f"{db}.bureau").groupBy("CREDIT_ACTIVE").agg(F.count("*").alias("n_rows"))
        before = spark.table(f"{db}.{stored[0]}").groupBy("CREDIT_ACTIVE").agg(F.count("*").alias("n_rows"))
        both = seen.withColumn("n_stored", F.lit(len(stored))).unionByName(before.withColumn("n_stored", F.lit(len(stored) - 1)))
        return layers.stage_write(both, scratch_path(spark, "seen"))
    finally:
        spark.sql(f"DROP DATABASE IF EXISTS {db} CASCADE")


def sql_over_views(spark, sf):
    """The history is folded per record before the join, so no record fans out."""
    bureau, balance = _history(spark, sf, "bureau", "bureau_balance")
    return layers.query(
        spark,
        "SELECT r.CREDIT_ACTIVE, SUM(COALESCE(h.n_rows, 1)) AS n_rows, SUM(COALESCE(h.n_status, 0)) AS n_status"
        " FROM {records} r LEFT JOIN (SELECT SK_ID_BUREAU, COUNT(*) AS n_rows, COUNT(STATUS) AS n_status"
        " FROM {history} GROUP BY SK_ID_BUREAU) h ON r.SK_ID_BUREAU = h.SK_ID_BUREAU"
        " GROUP BY r.CREDIT_ACTIVE",
        records=bureau, history=balance)


def registered_views(spark, sf):
    """The same over views registered by name."""
    layers.register(spark, {"credit_records": roles.bureau(spark, sf)})
    return spark.sql("SELECT CREDIT_TYPE, COUNT(*) AS n_rows FROM credit_records GROUP BY CREDIT_TYPE")


def reconcile_manifest(spark, sf):
    """Documents as files: the catalogued lengths against what a faulty landing would hold.

    Every document is expected. In the landing one source was moved, one got
    lost and one changed its size.
    """
    docs = roles.table(spark, sf, "documents")
    expected = docs.select(F.col("doc_id").cast("string").alias("name"), F.col("n_chars").alias("length"))
    landed = docs.where("NOT (source <=> 'src5')").selectExpr(
        "CONCAT(IF(source <=> 'src3', 'moved/', ''), doc_id) AS name",
        "CAST(LENGTH(text) + IF(source <=> 'src7', 1, 0) AS BIGINT) AS length")
    return manifest.reconcile_manifest(expected, landed)


def landed_files(spark, sf):
    """Files that this query writes: listing and fingerprint must name the same, with all lines."""
    path = scratch_path(spark, "landed")
    layers.export_csv(roles.bureau(spark, sf), f"{path}/bureau")
    layers.export_csv(roles.previous_application(spark, sf), f"{path}/previous")
    listed = manifest.list_files(spark, path)
    printed = manifest.content_fingerprint(spark, path)
    both = listed.join(printed, "name", "full")
    return both.agg(F.count_if(F.col("length").isNull() | F.col("n_lines").isNull()).alias("n_unmatched"),
                    (F.sum("n_lines") - F.count("n_lines")).alias("n_rows"))


def landing_checksums(spark, sf):
    """Length and CRC-32 of the files of a landing that this query writes: one per market segment."""
    path = scratch_path(spark, "landing")
    customers = roles.table(spark, sf, "customer").selectExpr(
        "c_mktsegment AS segment", "c_custkey", "CONCAT_WS(',', c_custkey, c_name, c_nationkey) AS line")
    (customers.repartition("segment").sortWithinPartitions("segment", "c_custkey").select("segment", "line")
     .write.partitionBy("segment").text(path))
    return (checksums(spark, path).where("name LIKE 'segment=%'")
            .select(F.substring_index("name", "=", -1).alias("segment"), "length", "crc32"))


def _faulty_landing(spark, sf):
    """Bureau records as CSV of three makes: with an amount in words, with a column more, with one less."""
    path = scratch_path(spark, "faulty")
    source = roles.bureau(spark, sf).selectExpr(
        "SK_ID_BUREAU", "DAYS_CREDIT", "CREDIT_ACTIVE", "SK_ID_BUREAU % 3 AS make",
        "IF(SK_ID_BUREAU % 12 = 0, 'many', CAST(DAYS_CREDIT AS STRING)) AS words")
    layers.export_csv(source.where("make = 0").select("SK_ID_BUREAU", F.col("words").alias("DAYS_CREDIT"), "CREDIT_ACTIVE"),
                      f"{path}/words")
    layers.export_csv(source.where("make = 1").select("SK_ID_BUREAU", "DAYS_CREDIT", F.lit(1).alias("ADDED"), "CREDIT_ACTIVE"),
                      f"{path}/more")
    layers.export_csv(source.where("make = 2").select("CREDIT_ACTIVE", "SK_ID_BUREAU"), f"{path}/less")
    schema = struct(long="SK_ID_BUREAU", int="DAYS_CREDIT", string="CREDIT_ACTIVE")
    return path, schema


def landing_quarantine(spark, sf):
    """What lands of the faulty landing, and what is put aside with its reason."""
    path, schema = _faulty_landing(spark, sf)
    rows = quarantine.checked(spark, path, schema)
    aside = quarantine.quarantined(rows).select("column", "reason", "value", F.get_json_object("row", "$.SK_ID_BUREAU")
                                                .cast("long").alias("SK_ID_BUREAU"))
    landed = quarantine.landed(rows, schema).select(
        F.lit(None).cast("string").alias("column"), F.lit("landed").alias("reason"),
        F.col("DAYS_CREDIT").cast("string").alias("value"), "SK_ID_BUREAU")
    return landed.unionByName(aside)


def header_drift(spark, sf):
    """Drift by column over the headers of the faulty landing."""
    path, schema = _faulty_landing(spark, sf)
    return quarantine.drift(quarantine.headers(spark, path), schema).select("column", "status").distinct()


def schema_diff(spark, sf):
    source = roles.bureau(spark, sf).select("SK_ID_CURR", "CREDIT_ACTIVE", "AMT_CREDIT_SUM", "DAYS_CREDIT")
    return projection.schema_diff(source, struct(double="AMT_CREDIT_SUM AMT_UNKNOWN", string="CREDIT_ACTIVE SK_ID_CURR"))


def preview_found(spark, sf):
    """How many rows a preview has, and how many of them are rows of the table."""
    bureau = roles.bureau(spark, sf)
    rows = bureau.select("SK_ID_BUREAU", F.lit(1).alias("known"))
    return (projection.preview(bureau, 5).join(rows, "SK_ID_BUREAU", "left")
            .agg(F.count(F.lit(1)).alias("n_rows"), F.count("known").alias("n_found")))


def landing_verdict(spark, sf):
    return manifest.landing_verdict(reconcile_manifest(spark, sf))


# ---- projections and expressions --------------------------------------------
def align_schema(spark, sf):
    """A required column the source lacks becomes a typed NULL; rows need an amount."""
    wanted = struct(double="AMT_CREDIT AMT_UNKNOWN", string="NAME_CONTRACT_TYPE NEW_LABEL")
    source = roles.previous_application(spark, sf).withColumn(
        "AMT_CREDIT", F.when(F.col("NAME_CONTRACT_STATUS") != "Canceled", F.col("AMT_CREDIT")))
    return projection.align_schema(source, wanted).where(F.col("AMT_CREDIT").isNotNull())


def scalar_expressions(spark, sf):
    app = roles.application(spark, sf)
    return app.select(
        F.col("SK_ID_CURR").alias("loanId"),
        days_to_years("DAYS_BIRTH").alias("age_round"),
        days_to_years("DAYS_BIRTH", digits=2).alias("age_two_digits"),
        days_to_years("DAYS_BIRTH", mode="floor").alias("age_floor"),
        ratio("AMT_CREDIT", "CNT_FAM_MEMBERS").alias("zero_ratio"),
        ratio("AMT_CREDIT", "CNT_FAM_MEMBERS", on_zero=None).alias("null_ratio"),
        like_flag("NAME_CONTRACT_TYPE", "%Cash%").alias("is_cash"),
        code_to_int(F.substring("NAME_INCOME_TYPE", 1, 1)).alias("no_code"),
        code_to_int(F.col("REGION_RATING_CLIENT").cast("string"), ["2", "3"]).alias("code"),
        sum_flags(["FLAG_MOBIL", "FLAG_PHONE", "FLAG_EMAIL"]).alias("contacts"),
        coalesce_key("AMT_ANNUITY", "EXT_SOURCE_1", "SK_ID_CURR").alias("first_known"),
        flag(F.col("AMT_GOODS_PRICE") > F.col("AMT_CREDIT")).alias("above_goods"),
    )


def sentinel_flags(spark, sf):
    app = roles.application(spark, sf)
    out = projection.sentinel(app, "DAYS_EMPLOYED", a.NOT_EMPLOYED, 0.0,
                              days_to_years("DAYS_EMPLOYED", digits=2), "isUnemployed",
                              "yearsEmployed")
    out = projection.encode_flag(out, ["FLAG_OWN_CAR", "FLAG_OWN_REALTY", "NOT_THERE"], partial=True)
    return out.select("SK_ID_CURR", "yearsEmployed", "isUnemployed", "FLAG_OWN_CAR",
                      "FLAG_OWN_REALTY")


def fill_defaults(spark, sf):
    prev = roles.previous_application(spark, sf).select(
        "SK_ID_PREV", "AMT_DOWN_PAYMENT", "CODE_REJECT_REASON", "NFLAG_INSURED_ON_APPROVAL")
    return projection.fill_defaults(prev, cleaned.default_fills("previous_application"), partial=True)


# ---- reports ----------------------------------------------------------------
def _on_view(report: Callable[..., DataFrame], *args, digits: int = 6, **kwargs) -> Query:
    def run(spark, sf):
        return rounded(report(roles.view(spark, sf), *args, **kwargs), digits)
    return run


def _on_bureau(dims: Callable[[], dict]) -> Query:
    def run(spark, sf):
        return rounded(k.bureau_rate_by(*_history(spark, sf, "bureau", "bureau_balance"),
                                        roles.view(spark, sf), dims()), 6)
    return run


def _on_histories(report: Callable[[DataFrame], DataFrame]) -> Query:
    def run(spark, sf):
        histories = k.loan_histories(*_history(spark, sf, "bureau", "bureau_balance"),
                                     roles.view(spark, sf))
        return rounded(report(histories), 6)
    return run


def _on(table: str, report: Callable[[DataFrame, DataFrame], DataFrame], digits: int = 6) -> Query:
    def run(spark, sf):
        return rounded(report(roles.HISTORY[table](spark, sf), roles.view(spark, sf)), digits)
    return run


def _grouped(table: str, groups, report) -> Query:
    return _on(table, lambda df, app: report(groups(df, app)))


def bureau_means(spark, sf):
    return rounded(k.bureau_means(*_history(spark, sf, "bureau", "bureau_balance"),
                                  roles.view(spark, sf)), 4)


def _composite(log: bool) -> Query:
    def run(spark, sf):
        return rounded(k.composite_score(*_history(spark, sf, "bureau", "bureau_balance"), log=log))
    return run


def compare_by_target(spark, sf):
    return rounded(reports.compare_by_target(roles.view(spark, sf), {
        "avg_credit": F.col("creditAmt"), "avg_annuity": F.col("annuityAmt"),
        "avg_age": F.col("ageYears")}), 4)


QUERIES: dict[str, Query] = {
    "bureau_features": bureau_features,
    "bureau_features_per_loan": bureau_features_per_loan,
    "previous_risk": lambda s, d: p.previous_risk(roles.previous_application(s, d)),
    "pos_risk": lambda s, d: p.pos_risk(roles.pos_cash_balance(s, d)),
    "installment_risk": lambda s, d: rounded(p.installment_risk(roles.installments_payments(s, d)), 6),
    "card_risk": lambda s, d: rounded(p.card_risk(roles.credit_card_balance(s, d)), 6),
    "card_risk_average": lambda s, d: rounded(
        p.card_risk(roles.credit_card_balance(s, d), "intended"), 6),
    "previous_full_outer": previous_full_outer,
    "previous_union_merge": previous_union_merge,
    "application_features": lambda s, d: rounded(_train(s, d)),
    "application_features_test": lambda s, d: rounded(_test(s, d)),
    "application_features_approx": lambda s, d: rounded(
        a.application_features(roles.application_train(s, d))),
    "gold": gold,
    "gold_layered": gold_layered,
    "gold_bucketed": gold_bucketed,
    "clean_bureau": _cleaned("bureau"),
    "clean_bureau_balance": _cleaned("bureau_balance"),
    "clean_previous": _cleaned("previous_application"),
    "clean_pos": _cleaned("POS_CASH_balance"),
    "clean_installments": _cleaned("installments_payments"),
    "clean_installments_in_place": _cleaned("installments_payments", mostly_unique=True),
    "clean_card": _cleaned("credit_card_balance"),
    "bureau_credit": bureau_credit,
    "delinquency": delinquency,
    "previous_application": lambda s, d: rounded(
        p.previous_application_features(_cleaned("previous_application")(s, d))),
    "pos_loan": lambda s, d: rounded(p.pos_loan_features(_cleaned("POS_CASH_balance")(s, d)), 6),
    "installment_payment": lambda s, d: rounded(
        p.installment_payment_features(_cleaned("installments_payments")(s, d))),
    "credit_card": lambda s, d: rounded(
        p.credit_card_features(_cleaned("credit_card_balance")(s, d))),
    "application_clean": lambda s, d: rounded(
        a.application_clean(roles.application_train(s, d), "median"), 6),
    "integrated": _integrated("train"),
    "integrated_test": _integrated("test"),
    "application_view": lambda s, d: rounded(roles.view(s, d), 6),
    "impute_median_exact": _imputed("median"),
    "impute_median_rel0": _imputed("approx_median", 0.0),
    "impute_median_approx": _imputed("approx_median", 0.01),
    "approx_median_bound": approx_median_bound,
    "median_per_loan": median_per_loan,
    "impute_mode": impute_mode,
    "impute_mode_of_many": impute_mode_of_many,
    "sketch_refit": sketch_refit,
    "footer_count": footer_count,
    "null_profile": lambda s, d: cleaning.null_profile(roles.application(s, d)),
    "dedup_by_key": dedup_by_key,
    "join_detail": join_detail,
    "cardinality_check": cardinality_check,
    "key_audit": key_audit,
    "validate_suite": validate_suite,
    "validate_loaded_suite": validate_loaded_suite,
    "validate_failing": validate_failing,
    "promote": promote,
    "csv_roundtrip": csv_roundtrip,
    "layer_roundtrip": layer_roundtrip,
    "publish_verify": publish_verify,
    "published_content": published_content,
    "sql_over_views": sql_over_views,
    "registered_views": registered_views,
    "landed_files": landed_files,
    "landing_checksums": landing_checksums,
    "landing_quarantine": landing_quarantine,
    "header_drift": header_drift,
    "published_versions": published_versions,
    "schema_diff": schema_diff,
    "preview_found": preview_found,
    "reconcile_manifest": reconcile_manifest,
    "landing_verdict": landing_verdict,
    "align_schema": align_schema,
    "scalar_expressions": scalar_expressions,
    "sentinel_flags": sentinel_flags,
    "fill_defaults": fill_defaults,
    "preview": lambda s, d: projection.preview(roles.view(s, d), 5),
    "rate_by_contract": _on_view(j.rate_by, "contractType"),
    "contract_finances": _on_view(j.contract_finances, digits=4),
    "rate_by_suite": _on_view(j.rate_by, "suiteType"),
    "rate_by_assets": _on_view(j.rate_by, "ownCar", "ownRealty"),
    "asset_finances": _on_view(j.asset_finances, digits=4),
    "annuity_distribution": _on_view(j.annuity_distribution, digits=4),
    "age_by_assets": _on_view(j.age_by_assets),
    "family_by_assets": _on_view(j.family_by_assets),
    "goods_price_counts": _on_view(j.goods_price_counts),
    "gap_topk": _on_view(j.gap_extremes, 20, True),
    "gap_bottomk": _on_view(j.gap_extremes, 20, False),
    "zero_gap": _on_view(j.zero_gap),
    "gap_extremes_union": _on_view(j.gap_extremes_combined),
    "gap_extremes_target": _on_view(j.gap_extremes_combined, with_target=True),
    "rate_by_income_type": _on_view(j.rate_by, "incomeType"),
    "income_type_averages": _on_view(j.rate_with_averages, "incomeType", digits=4),
    "identity_age": _on_view(j.identity_age),
    "contact_score": _on_view(j.contact_score),
    "occupation_rates": _on_view(j.occupation_rates),
    "occupation_averages": _on_view(j.rate_with_averages, "occupation", digits=4),
    "occupation_groups": _on_view(j.occupation_groups),
    "rate_reports": _on_view(k.rate_reports),
    "rate_by_weekday": _on_view(k.rate_by_weekday),
    "rate_by_hour_group": _on_view(k.rate_by_hour_group),
    "rate_by_region": _on_view(k.rate_by_region, digits=4),
    "rate_by_commute": _on_view(k.rate_by_commute),
    "recommended_flags": _on_view(k.recommended_flags),
    "compare_by_target": compare_by_target,
    "bureau_means": bureau_means,
    "history_means": _on_histories(k.history_means),
    "record_means": _on("bureau", k.record_means, 4),
    "installment_means": _on("installments_payments", k.installment_means, 4),
    "underpaid_rate": _on("installments_payments", k.underpaid_rate),
    "card_means": _on("credit_card_balance", k.card_means, 4),
    "utilization_group": _on_bureau(lambda: {"util_group": k.utilization_group()}),
    "overdue_severity": _on_bureau(lambda: {"overdue_severity": k.overdue_severity()}),
    "update_recency": _on_bureau(lambda: {"update_recency": k.update_recency()}),
    "rate_by_credit_type": _on_bureau(lambda: {"creditType": "creditType"}),
    "rate_by_credit_status": _on_bureau(lambda: {"creditActive": "creditActive"}),
    "delinquent_category": _on_histories(k.delinquent_category),
    "trend_group": _on_histories(k.trend_group),
    "history_group": _on_histories(k.history_group),
    "composite_score": _composite(log=False),
    "composite_score_log": _composite(log=True),
    "debt_ratio_bucket": _on("bureau", k.debt_ratio_bucket),
    "active_ratio_bucket": _on("bureau", k.active_ratio_bucket),
    "refusals_by_target": _on("previous_application", k.refusals_by_target),
    "rate_by_reject_reason": _on("previous_application", k.rate_by_reject_reason),
    "rate_by_decision_recency": _on("previous_application", k.rate_by_decision_recency),
    "remaining_bucket": _on("POS_CASH_balance", k.remaining_bucket),
    "pos_risk_profile": _on("POS_CASH_balance", k.pos_risk_profile),
    "late_bucket": _grouped("installments_payments", k.installment_groups, k.late_bucket),
    "payment_diff_bucket": _grouped("installments_payments", k.installment_groups,
                                    k.payment_diff_bucket),
    "version_group": _grouped("installments_payments", k.installment_groups, k.version_group),
    "card_utilization_bucket": _grouped("credit_card_balance", k.card_groups,
                                        k.card_utilization_bucket),
    "pay_ratio_bucket": _grouped("credit_card_balance", k.card_groups, k.pay_ratio_bucket),
    "net_borrowing_bucket": _grouped("credit_card_balance", k.card_groups, k.net_borrowing_bucket),
}
