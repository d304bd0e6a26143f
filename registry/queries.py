"""One named query per operator and report."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cartwright.config import DRIVER_CONFIG as CONFIG
from cartwright.config import FUNNEL_APPAREL_PATTERN, FUNNEL_STEPS, STEP_FLAGS
from cartwright.functions.columns import (
    earliest,
    event_time,
    family_patterns,
    label_rank,
    pct,
    period_label,
    phase_label,
    placeholder_transaction,
    product_family,
    raw_day_between,
    session_key,
    user_type,
    valid_transaction,
)
from cartwright.ml import eda, evaluate, importance, models, preprocess, scoring
from cartwright.ml import split as splitting
from cartwright.operators import cohorts, customers, orders, sessions, shape, shares
from cartwright.plans import audit, kpi, repeat, retention, segments
from cartwright.sources import tables
from cartwright.sources.staging import staging_path
from registry import inputs
from registry.inputs import KEY, LABEL, shaped, shaped_customers

Query = Callable[[SparkSession, str], DataFrame]

ALL_STEPS = tuple(STEP_FLAGS)


def purchases(spark, sf) -> DataFrame:
    return shape.purchase_rows(shaped(spark, sf))


# --- sources and sinks ------------------------------------------------------


def src_events(spark, sf):
    return shape.shape_events(inputs.events(spark, sf)).select(
        "event_id",
        "event_timestamp",
        "event_date",
        "event_name",
        "user_pseudo_id",
        "ga_session_id",
        "device_category",
        "first_source",
        "first_medium",
        "transaction_id",
        "purchase_revenue",
        "total_item_quantity",
        "item_category",
    )


def src_event_days(spark, sf):
    """Events a day of a store that was loaded in two calls, one day of it twice."""
    path = staging_path(inputs.use_local_folder(spark), "event-days")
    events = inputs.events(spark, sf)
    middle = events.agg(F.percentile(F.col("event_date").cast("int"), 0.5)).first()[0]
    cut = F.lit(str(int(middle or 0)))
    tables.load_days(events.where(F.col("event_date") <= cut), path)
    tables.load_days(events.where(F.col("event_date") > cut), path)
    tables.load_days(events.where(F.col("event_date") == cut), path)
    return (
        tables.read_events(spark, path)
        .groupBy("event_date")
        .agg(F.count("*").alias("events"), F.count_distinct("event_id").alias("distinct_events"))
    )


def src_feature_table(spark, sf):
    return inputs.features(spark, sf)


def src_feature_csv(spark, sf):
    path = staging_path(spark, "features-csv")
    tables.write_feature_csv(inputs.features(spark, sf), path, LABEL)
    return tables.read_feature_csv(spark, path, LABEL)


def src_profile(spark, sf):
    return tables.profile(inputs.features(spark, sf))


def sink_feature_table(spark, sf):
    rows = inputs.features(spark, sf)
    parquet = staging_path(spark, "features-out")
    csv = staging_path(spark, "features-out-csv")
    tables.write_feature_table(rows, parquet, LABEL)
    tables.write_feature_csv(rows, csv, LABEL)
    stored = {
        "parquet": tables.read_feature_table(spark, parquet, LABEL),
        "csv": tables.read_feature_csv(spark, csv, LABEL),
    }
    written = [df.withColumn("stored_as", F.lit(kind)) for kind, df in stored.items()]
    return written[0].unionByName(written[1])


def sink_eval_tables(spark, sf):
    results = {
        "model_comparison": ml_comparison_rows(spark, sf),
        "permutation_importance": ml_permutation_importance(spark, sf),
        "logistic_regression_coefficients": ml_coefficients(spark, sf),
    }
    folder = staging_path(spark, "evaluation")
    tables.write_evaluation_tables(results, folder)
    counts = [
        spark.read.option("header", True)
        .csv(f"{folder}/{name}")
        .agg(F.count("*").alias("row_count"))
        .select(F.lit(name).alias("table_name"), "row_count")
        for name in results
    ]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


# --- event shaping and filters ----------------------------------------------


def columns_of(*names: str) -> Query:
    return lambda spark, sf: shaped(spark, sf).select(*names)


def shape_items_explode(spark, sf):
    return shape.explode_items(shaped(spark, sf)).select("event_id", "event_name", "item_category")


def shape_event_time(spark, sf):
    return shaped(spark, sf).select(
        "event_id", "event_name", event_time("event_timestamp").alias("event_time")
    )


def filter_funnel_events(spark, sf):
    return shape.filter_events(shaped(spark, sf), FUNNEL_STEPS).select(
        "event_id", "event_name", "user_pseudo_id"
    )


def filter_valid_keys(spark, sf):
    return shape.filter_valid_keys(shaped(spark, sf)).select(
        "event_id", "event_name", "user_pseudo_id", "ga_session_id"
    )


def filter_valid_transaction(spark, sf):
    return purchases(spark, sf).select(
        "event_id",
        "transaction_id",
        valid_transaction(rule="strict").alias("valid_strict"),
        valid_transaction(rule="nonblank").alias("valid_nonblank"),
    )


def filter_placeholder_transaction(spark, sf):
    return purchases(spark, sf).where(placeholder_transaction()).select("event_id", "transaction_id")


def filter_date_window(spark, sf):
    month = CONFIG.audit_month
    raw = inputs.events(spark, sf).where(raw_day_between("event_date", month.start, month.end))
    return shape.filter_days(shape.shape_events(raw), month.start, month.end).select(
        "event_id", "event_name", "event_day"
    )


def session_keys(spark, sf):
    return shaped(spark, sf).select("event_id", "event_name", session_key().alias("session_key"))


# --- sessions ---------------------------------------------------------------


def session_flags(spark, sf):
    return sessions.session_flags(shaped(spark, sf), ALL_STEPS)


def session_step_times(spark, sf):
    return sessions.session_step_times(shaped(spark, sf))


def session_bounds(spark, sf):
    return sessions.roll_up(shaped(spark, sf), FUNNEL_STEPS, sessions.bounds())


def session_start_date(spark, sf):
    return sessions.roll_up(shaped(spark, sf), FUNNEL_STEPS, [sessions.start_date()])


def session_first_attr(spark, sf):
    events = shaped(spark, sf).withColumn("product_family", product_family("item_category"))
    picks = [
        sessions.first_device(),
        *sessions.first_channel(),
        earliest("product_family", "view_item").alias("product_family"),
    ]
    return sessions.roll_up(events, FUNNEL_STEPS, picks)


def session_daily_flags(spark, sf):
    return sessions.session_daily_flags(shaped(spark, sf), kpi.MAIN_STEPS)


def funnel_completeness_flags(spark, sf):
    return sessions.completeness(session_step_times(spark, sf)).select(
        *sessions.SESSION, "has_all_core_steps", "has_ordered_core_funnel"
    )


def user_types(spark, sf):
    return session_flags(spark, sf).select(*sessions.SESSION, user_type().alias("user_type"))


def period_bucket(spark, sf):
    return session_start_date(spark, sf).select(
        *sessions.SESSION,
        "session_date",
        period_label("session_date", CONFIG.compare).alias("compared_period"),
        period_label("session_date", CONFIG.periods, "outside").alias("period"),
        phase_label("session_date", CONFIG.transition_day).alias("phase"),
    )


def period_order(spark, sf):
    counts = period_bucket(spark, sf).groupBy("phase").agg(F.count("*").alias("sessions"))
    rank = label_rank("phase", ("Stable period", "Transition day"))
    return counts.select("phase", rank.alias("phase_rank"), "sessions").orderBy("phase_rank")


def families(spark, sf):
    doubled = family_patterns(FUNNEL_APPAREL_PATTERN)
    views = shaped(spark, sf).where(F.col("event_name") == "view_item")
    return (
        views.groupBy("item_category")
        .agg(F.count("*").alias("views"))
        .select(
            "item_category",
            "views",
            product_family("item_category").alias("family"),
            product_family("item_category", doubled).alias("family_doubled_apostrophe"),
        )
    )


# --- orders -----------------------------------------------------------------


def purchase_rows(spark, sf):
    return purchases(spark, sf).select(
        "event_id",
        "event_timestamp",
        "event_day",
        "user_pseudo_id",
        "ga_session_id",
        "transaction_id",
        "purchase_revenue",
        "total_item_quantity",
    )


def transaction_summary(spark, sf):
    return orders.transaction_summary(purchases(spark, sf))


def order_consistency(spark, sf):
    return orders.order_consistency(purchases(spark, sf))


def session_transaction_count(spark, sf):
    bought = purchases(spark, sf)
    ids = orders.session_transaction_count(bought).select(
        F.lit("valid").alias("kind"),
        *sessions.SESSION,
        F.col("transaction_ids_in_session").alias("n"),
        F.lit(None).cast("long").alias("revenue_versions"),
    )
    placeholders = orders.placeholder_sessions(bought).select(
        F.lit("placeholder").alias("kind"),
        *sessions.SESSION,
        F.col("purchase_events").alias("n"),
        "revenue_versions",
    )
    return ids.unionByName(placeholders)


def clean_orders(spark, sf):
    valid = shape.valid_purchases(purchases(spark, sf))
    grains = [
        orders.clean_orders(valid, grain).withColumn("grain", F.lit(grain))
        for grain in orders.GRAINS
    ]
    return grains[0].unionByName(grains[1]).unionByName(grains[2], allowMissingColumns=True)


def customer_orders(spark, sf, grain="session"):
    return repeat.orders_in_window(inputs.customer_events(spark, sf), CONFIG, grain)


def ranked_orders(spark, sf):
    return orders.ranked_orders(customer_orders(spark, sf))


def first_second_purchase(spark, sf):
    bought = customer_orders(spark, sf)
    by = [
        orders.first_second_purchase(bought, first).withColumn("first_rule", F.lit(first))
        for first in ("rank", "min")
    ]
    return by[0].unionByName(by[1])


def orders_within_days(spark, sf):
    bought = customer_orders(spark, sf, "user")
    buyers = orders.first_second_purchase(bought, "min").drop("second_purchase_date")
    return orders.orders_within_days(buyers, bought, CONFIG.outcome_days)


# --- cohorts ----------------------------------------------------------------


def user_day_activity(spark, sf):
    return cohorts.user_day_activity(shaped_customers(spark, sf))


def first_visit_date(spark, sf):
    return cohorts.first_visit_date(user_day_activity(spark, sf))


def cohort_week(spark, sf):
    return cohorts.cohort_week(first_visit_date(spark, sf), drop_through=CONFIG.partial_cohort_until)


def cohort_sizes(spark, sf):
    return cohorts.cohort_sizes(cohorts.cohort_week(first_visit_date(spark, sf)))


def weeks_since(spark, sf):
    activity = user_day_activity(spark, sf)
    floors = [
        cohorts.weeks_since(cohorts.user_weeks(activity, floor)).withColumn(
            "floor", F.lit(floor)
        )
        for floor in ("visit", "cohort")
    ]
    return floors[0].unionByName(floors[1])


def retained_users(spark, sf):
    weeks = cohorts.weeks_since(cohorts.user_weeks(user_day_activity(spark, sf)))
    return cohorts.retained_users(weeks, CONFIG.summary_weeks)


def dataset_end(spark, sf):
    return cohorts.dataset_end(user_day_activity(spark, sf))


def cohort_table(spark, sf, floor="visit"):
    return retention.cohorts_of(inputs.customer_events(spark, sf), floor)


def cohort_rates(spark, sf):
    rated = cohorts.cohort_rates(cohort_table(spark, sf), CONFIG.summary_weeks)
    rates = [F.round(f"week_{w}_rate", 6).alias(f"week_{w}_rate") for w in CONFIG.summary_weeks]
    return rated.select("cohort_week", "cohort_month", "cohort_size", *rates)


def weighted_rate(spark, sf):
    weeks = CONFIG.summary_weeks
    rated = cohorts.week_eligibility(cohorts.cohort_rates(cohort_table(spark, sf), weeks), weeks)
    return rated.agg(*[cohorts.weighted_rate(w).alias(f"week_{w}_pct") for w in weeks])


def cohort_grid(spark, sf):
    return cohorts.cohort_grid(cohort_table(spark, sf), CONFIG.max_retention_week).drop(
        "retained_by_week"
    )


def observable_mask(spark, sf):
    grid = cohorts.cohort_grid(cohort_table(spark, sf, "cohort"), CONFIG.max_retention_week)
    return cohorts.observable_mask(grid).select(
        "cohort_week", "week_number", "retention_rate_pct"
    )


def week_eligibility(spark, sf):
    eligible = cohorts.week_eligibility(cohort_table(spark, sf), CONFIG.summary_weeks)
    return eligible.drop("retained_by_week")


# --- shares and decompositions ----------------------------------------------


def safe_pct(spark, sf):
    daily = shaped(spark, sf).groupBy("user_pseudo_id", "event_day").agg(
        F.count_if(F.col("event_name") == "purchase").alias("bought"),
        F.count_if(F.col("event_name") == "view_item").alias("viewed"),
    )
    return daily.select("*", pct("bought", "viewed").alias("bought_per_view_pct"))


def share_of_total(spark, sf):
    counts = (
        shaped(spark, sf).groupBy("event_name", "device_category").agg(F.count("*").alias("n"))
    )
    return counts.select("*", shares.share_of_total("n", ["event_name"]).alias("share_pct"))


def share_of_grand_total(spark, sf):
    counts = shaped(spark, sf).groupBy("event_name").agg(F.count("*").alias("n"))
    return counts.select("*", shares.share_of_grand_total("n").alias("share_pct"))


def device_rates(spark, sf):
    """Sessions and purchase rate per compared period and device."""
    events = shaped(spark, sf)
    flags = sessions.flags(kpi.MAIN_STEPS)
    picks = [sessions.start_date(), sessions.first_device()]
    rows = sessions.roll_up(events, kpi.MAIN_STEPS, [*picks, *flags])
    return (
        segments.in_periods(rows, CONFIG.compare)
        .groupBy("period", "device_category")
        .agg(
            F.count("*").alias("sessions"),
            F.try_divide(kpi.reached("purchased"), F.count("*")).alias("rate"),
        )
    )


def mix_rate_decomposition(spark, sf):
    names = {
        "before": (0, 0),
        "after": (1, 1),
        "after_with_mix_before": (0, 1),
        "after_with_rate_before": (1, 0),
    }
    labels = tuple(p.label for p in CONFIG.compare)
    return shares.mix_rate_decomposition(
        device_rates(spark, sf), labels, "device_category", "sessions", "rate", names
    )


def scope_union(spark, sf):
    counts = families(spark, sf).groupBy("family").agg(F.sum("views").alias("views"))
    return shares.stack_scopes(
        counts, F.col("family") != "(not set)", "All product families", "Known categories only"
    )


# --- customers at the first order -------------------------------------------


def first_orders(spark, sf):
    events = repeat.feature_events(inputs.customer_events(spark, sf), CONFIG)
    return events, repeat.eligible_first_orders(events, CONFIG)


def repeat_label(spark, sf):
    _, buyers = first_orders(spark, sf)
    return buyers.select(
        KEY,
        "first_order_timestamp",
        customers.repeat_label(CONFIG.outcome_days).alias("repeat_purchase"),
    )


def point_in_time_features(spark, sf):
    events, buyers = first_orders(spark, sf)
    seen = customers.point_in_time_features(buyers, events)
    counts = [c for c in seen.columns if c.endswith(("_before_purchase", "_first_purchase"))]
    return seen.select(KEY, *counts, "first_visit_timestamp")


def calendar_features(spark, sf):
    _, buyers = first_orders(spark, sf)
    return buyers.withColumns(customers.calendar_features()).select(
        KEY, "purchase_day_of_week", "purchase_hour_utc"
    )


def days_since_first_visit(spark, sf):
    events, buyers = first_orders(spark, sf)
    return customers.point_in_time_features(buyers, events).select(
        KEY, customers.days_since_first_visit().alias("days_first_visit_to_purchase")
    )


# --- exploration and modelling ----------------------------------------------


def on_features(report: Callable, *args) -> Query:
    return lambda spark, sf: report(inputs.features(spark, sf), *args)


def ml_feature_validation(spark, sf):
    return repeat.ml_feature_validation(inputs.features(spark, sf), CONFIG)


def ml_stratified_split(spark, sf):
    return inputs.split(spark, sf).select(KEY, LABEL, "split")


def ml_split_profile(spark, sf):
    return splitting.split_profile(inputs.split(spark, sf), LABEL)


def train(spark, sf):
    return inputs.part(spark, sf, "train")


def test(spark, sf):
    return inputs.part(spark, sf, "test")


def long_rows(df: DataFrame, columns: list[str], value: str) -> DataFrame:
    return df.select(KEY, *columns).unpivot(KEY, columns, "feature", value)


def ml_median_impute(spark, sf):
    imputation = preprocess.fit_imputation(train(spark, sf))
    filled = imputation.numerics(inputs.split(spark, sf))
    rows = long_rows(filled, imputation.numeric_columns, "value")
    return rows.select(KEY, "feature", F.round("value", 6).alias("value"))


def ml_standardise(spark, sf):
    fitted = preprocess.fit_preprocessing(train(spark, sf))
    scaled = fitted.prepare(inputs.split(spark, sf))
    rows = long_rows(scaled, fitted.imputation.numeric_columns, "value")
    return rows.select(KEY, "feature", F.round("value", 6).alias("value"))


def ml_mode_impute(spark, sf):
    imputation = preprocess.fit_imputation(train(spark, sf))
    filled = imputation.categories(inputs.split(spark, sf))
    names = [c for c in filled.columns if c.startswith("text__")]
    return long_rows(filled, names, "value")


def encoded(spark, sf):
    """All rows as feature vectors, and the table of the slots."""
    fitted = preprocess.fit_preprocessing(train(spark, sf))
    encoding = preprocess.fit_encoding(
        fitted.prepare(train(spark, sf)), fitted.imputation
    )
    vectors = encoding.transform(fitted.prepare(inputs.split(spark, sf)))
    return vectors, encoding.slots


def vector_entries(spark, sf):
    """The entries of the feature vectors that are not zero."""
    vectors, slots = encoded(spark, sf)
    entries = vectors.select(
        KEY, F.posexplode(models.vector_to_array("features")).alias("slot", "value")
    )
    rounded = entries.select(KEY, "slot", F.round("value", 6).alias("value")).where("value <> 0")
    return rounded.join(slots, "slot").select(KEY, "feature", "value")


def ml_one_hot(spark, sf):
    hot = vector_entries(spark, sf).where(F.col("feature").startswith("cat__"))
    return hot.select(KEY, "feature")


def ml_class_weights(spark, sf):
    weights = models.class_weights(train(spark, sf), LABEL)
    return weights.select(LABEL, F.round("class_weight", 9).alias("class_weight"))


def ml_logistic_fit(spark, sf):
    return models.coefficients(inputs.model(spark, sf, "logistic"))


def ml_forest_fit(spark, sf):
    return models.split_importances(inputs.model(spark, sf, "forest"))


def predictions(spark, sf, kind="logistic"):
    return inputs.model(spark, sf, kind).predict(test(spark, sf))


def ml_predict(spark, sf):
    both = [
        predictions(spark, sf, kind).select(
            F.lit(kind).alias("model"), KEY, LABEL, "predicted", "score"
        )
        for kind in ("logistic", "forest")
    ]
    return both[0].unionByName(both[1])


def curve(spark, sf):
    return evaluate.score_curve(inputs.scored_documents(spark, sf))


def ml_classification_report(spark, sf):
    return evaluate.classification_report(inputs.scored_documents(spark, sf))


def ml_confusion_matrix(spark, sf):
    return evaluate.confusion_matrix(inputs.scored_documents(spark, sf))


def ml_roc_auc(spark, sf):
    return evaluate.roc_auc(curve(spark, sf)).select(F.round("roc_auc", 6).alias("roc_auc"))


def ml_average_precision(spark, sf):
    return evaluate.average_precision(curve(spark, sf)).select(
        F.round("average_precision", 6).alias("average_precision")
    )


# Each report of the held-out rows by the fitted models. The keys, labels and row totals
# are checked against SQL; the measures themselves on the fixed scores above and below.


def on_models(report: Callable) -> Query:
    """``report`` over the predictions of each fitted model, one after the other."""

    def query(spark, sf):
        parts = [
            report(predictions(spark, sf, kind)).select(F.lit(kind).alias("model"), "*")
            for kind in ("logistic", "forest")
        ]
        return parts[0].unionByName(parts[1])

    return query


def model_measures(scored: DataFrame) -> DataFrame:
    return evaluate.model_scores(scored, LABEL, "").select(
        F.round("ROC_AUC", 6).alias("roc_auc"), F.round("PR_AUC", 6).alias("average_precision")
    )


def logistic_curve(spark, sf):
    return evaluate.pr_curve(evaluate.score_curve(predictions(spark, sf), LABEL))


def ml_model_support(spark, sf):
    """What the reports of the fitted models count: held-out rows per model and class."""
    reports = all_queries()
    support = reports["ml_model_classification_report"](spark, sf)
    matrix = reports["ml_model_confusion_matrix"](spark, sf)
    return (
        support.where("row in ('0', '1')")
        .select("model", F.col("row").cast("int").alias("actual"), "support")
        .join(matrix, ["model", "actual"])
        .select(
            "model",
            "actual",
            "support",
            (F.col("predicted_0") + F.col("predicted_1")).alias("matrix_rows"),
        )
    )


def ml_predict_rows(spark, sf):
    """Every held-out row once per model, with its label and a probability as score."""
    return ml_predict(spark, sf).select(
        "model",
        KEY,
        LABEL,
        F.col("score").between(0, 1).alias("score_in_range"),
        (F.col("predicted") == (F.col("score") > 0.5).cast("int")).alias("class_follows_score"),
    )


def ml_logistic_optimum(spark, sf):
    """Per slot, whether the penalised gradient vanishes: the problem has one optimum."""
    fitted = inputs.model(spark, sf, "logistic")
    return models.penalised_gradient(fitted, train(spark, sf), LABEL).select(
        "feature", (F.abs("gradient") < 1e-3).alias("vanishes")
    )


def ml_forest_slots(spark, sf):
    """Slots of the forest; importances are not negative and sum to one."""
    slots = ml_forest_fit(spark, sf)
    total = slots.agg(F.round(F.sum("split_importance"), 6)).scalar()
    return slots.select(
        "feature",
        (F.col("split_importance") >= 0).alias("not_negative"),
        total.alias("total"),
    )


class FixedScore:
    """A known linear score in place of a fitted model, so its measures can be stated in SQL."""

    def predict(self, df: DataFrame) -> DataFrame:
        def filled(c):
            return F.coalesce(F.col(c).cast("double"), F.lit(0.0))

        score = (
            filled("first_order_items") * 4
            + filled("product_views_before_purchase") * 2
            + filled("sessions_before_first_purchase")
        )
        return df.select("*", (score > 16).cast("int").alias("predicted"), score.alias("score"))


def ml_importance_fixed_score(spark, sf):
    found = importance.permutation_importance(FixedScore(), test(spark, sf), LABEL, KEY)
    return found.select(
        "feature", F.round("importance", 9).alias("importance"), F.round("std", 9).alias("std")
    )


def ml_comparison_fixed_score(spark, sf):
    scored = FixedScore().predict(test(spark, sf))
    return evaluate.model_scores(scored, LABEL, "Fixed score").select(
        "Model", F.round("ROC_AUC", 6).alias("ROC_AUC"), F.round("PR_AUC", 6).alias("PR_AUC")
    )


def agreement(spark, sf, kind: str) -> DataFrame:
    """Held-out rows with the model's score and the one found from its tables."""
    fitted = inputs.model(spark, sf, kind)
    rows = test(spark, sf)
    if kind == "logistic":
        table = scoring.linear_scores(fitted, rows, KEY)
    else:
        table = scoring.forest_scores(fitted, inputs.nodes(spark, sf), rows, KEY)
    return predictions(spark, sf, kind).select(KEY, "score").join(table, KEY, "left")


def ml_predict_agreement(spark, sf):
    """Whether both scores of each held-out row and model agree to 1e-9."""
    close = F.coalesce(F.abs(F.col("score") - F.col("table_score")) <= 1e-9, F.lit(False))
    parts = [
        agreement(spark, sf, kind).select(F.lit(kind).alias("model"), KEY, close.alias("agrees"))
        for kind in ("logistic", "forest")
    ]
    return parts[0].unionByName(parts[1])


def ml_forest_nodes(spark, sf):
    """Whether each tree of the node table keeps its bounds and its nodes add up."""
    return scoring.forest_facts(inputs.nodes(spark, sf))


def ml_forest_node_importance(spark, sf):
    """Per slot, whether the importance from the node table is the model's."""
    fitted = inputs.model(spark, sf, "forest")
    own = fitted.encoding.named(fitted.classifier.featureImportances.toArray())
    found = scoring.node_importances(inputs.nodes(spark, sf))
    gap = F.abs(F.col("value") - F.coalesce("importance", F.lit(0.0)))
    return own.join(found, "slot", "left").select("feature", (gap <= 1e-9).alias("equal"))


def ml_signed_slots(spark, sf):
    """Whether the ten largest and smallest coefficients are those of the whole table."""
    coefs = ml_coefficients(spark, sf)
    top = ml_top_signed_coefficients(spark, sf)
    rank = {
        "positive": F.row_number().over(W.orderBy(F.desc("coefficient"), "feature")),
        "negative": F.row_number().over(W.orderBy("coefficient", "feature")),
    }
    ranked = [
        coefs.select(F.lit(d).alias("direction"), "feature", r.alias("place"))
        for d, r in rank.items()
    ]
    places = ranked[0].unionByName(ranked[1])
    return top.join(places, ["direction", "feature"]).select("direction", "place")


def ml_pr_curve(spark, sf):
    points = evaluate.pr_curve(curve(spark, sf))
    return points.select(
        "threshold", F.round("precision", 9).alias("precision"), F.round("recall", 9).alias("recall")
    )


def ml_threshold_f1(spark, sf):
    return evaluate.threshold_f1(evaluate.pr_curve(curve(spark, sf)))


def ml_comparison_rows(spark, sf):
    names = {"logistic": "Logistic Regression", "forest": "Random Forest"}
    rows = [
        evaluate.model_scores(predictions(spark, sf, kind), LABEL, name)
        for kind, name in names.items()
    ]
    return rows[0].unionByName(rows[1])


def ml_model_comparison(spark, sf):
    return ml_comparison_rows(spark, sf).select(
        "Model", F.round("ROC_AUC", 3).alias("ROC_AUC"), F.round("PR_AUC", 3).alias("PR_AUC")
    )


def ml_coefficients(spark, sf):
    return models.coefficients(inputs.model(spark, sf, "logistic"))


def ml_top_signed_coefficients(spark, sf):
    return models.top_signed(ml_coefficients(spark, sf))


def ml_permutation_importance(spark, sf):
    fitted = inputs.model(spark, sf, "logistic")
    return importance.permutation_importance(fitted, test(spark, sf), LABEL, KEY)


def report(function: Callable, source: Callable) -> Query:
    return lambda spark, sf: function(source(spark, sf), CONFIG)


def session_report(function: Callable) -> Query:
    """A report over the session table that all of them share."""
    return lambda spark, sf: function(None, CONFIG, sessions=inputs.sessions(spark, sf))


def all_queries() -> dict[str, Query]:
    found: dict[str, Query] = {
        "src_events": src_events,
        "src_event_days": src_event_days,
        "src_feature_table": src_feature_table,
        "src_feature_csv": src_feature_csv,
        "src_profile": src_profile,
        "sink_feature_table": sink_feature_table,
        "sink_eval_tables": sink_eval_tables,
        "shape_event_param": columns_of(
            "event_id", "event_timestamp", "event_name", "ga_session_id"
        ),
        "shape_struct_fields": columns_of(
            "event_id",
            "event_name",
            "device_category",
            "first_source",
            "first_medium",
            "transaction_id",
            "purchase_revenue",
            "total_item_quantity",
        ),
        "shape_items_explode": shape_items_explode,
        "shape_item_category_any": columns_of("event_id", "event_name", "item_category"),
        "shape_event_date": columns_of("event_id", "event_name", "event_date", "event_day"),
        "shape_event_time": shape_event_time,
        "filter_funnel_events": filter_funnel_events,
        "filter_valid_keys": filter_valid_keys,
        "filter_valid_transaction": filter_valid_transaction,
        "filter_placeholder_transaction": filter_placeholder_transaction,
        "filter_date_window": filter_date_window,
        "session_key": session_keys,
        "session_flags": session_flags,
        "session_step_times": session_step_times,
        "session_bounds": session_bounds,
        "session_start_date": session_start_date,
        "session_first_attr": session_first_attr,
        "session_daily_flags": session_daily_flags,
        "funnel_completeness_flags": funnel_completeness_flags,
        "user_type": user_types,
        "period_bucket": period_bucket,
        "period_order": period_order,
        "product_family": families,
        "purchase_rows": purchase_rows,
        "transaction_summary": transaction_summary,
        "order_consistency": order_consistency,
        "session_transaction_count": session_transaction_count,
        "clean_orders": clean_orders,
        "ranked_orders": ranked_orders,
        "first_second_purchase": first_second_purchase,
        "orders_within_days": orders_within_days,
        "user_day_activity": user_day_activity,
        "first_visit_date": first_visit_date,
        "cohort_week": cohort_week,
        "cohort_sizes": cohort_sizes,
        "weeks_since": weeks_since,
        "retained_users": retained_users,
        "dataset_end": dataset_end,
        "cohort_rates": cohort_rates,
        "weighted_rate": weighted_rate,
        "cohort_grid": cohort_grid,
        "observable_mask": observable_mask,
        "week_eligibility": week_eligibility,
        "safe_pct": safe_pct,
        "share_of_total": share_of_total,
        "share_of_grand_total": share_of_grand_total,
        "mix_rate_decomposition": mix_rate_decomposition,
        "scope_union": scope_union,
        "repeat_label": repeat_label,
        "point_in_time_features": point_in_time_features,
        "calendar_features": calendar_features,
        "days_since_first_visit": days_since_first_visit,
    }
    for module in (audit, kpi, segments):
        found |= {name: report(f, inputs.events) for name, f in module.REPORTS.items()}
        found |= {name: session_report(f) for name, f in module.SESSION_REPORTS.items()}
    for module in (retention, repeat):
        found |= {name: report(f, inputs.customer_events) for name, f in module.REPORTS.items()}
    found |= {
        "ml_feature_validation": ml_feature_validation,
        "eda_target_distribution": on_features(eda.target_distribution, LABEL),
        "eda_missing_summary": on_features(eda.missing_summary),
        "eda_means_by_target": on_features(eda.means_by_target, LABEL),
        "eda_missing_by_target": on_features(eda.missing_by_target, LABEL),
        "eda_days_stats_by_target": on_features(eda.days_stats_by_target, LABEL),
        "eda_device_summary": on_features(eda.device_summary, LABEL),
        "eda_source_summary": on_features(eda.source_summary, LABEL),
        "ml_select": on_features(eda.model_columns, LABEL),
        "ml_stratified_split": ml_stratified_split,
        "ml_split_profile": ml_split_profile,
        "ml_median_impute": ml_median_impute,
        "ml_standardise": ml_standardise,
        "ml_mode_impute": ml_mode_impute,
        "ml_one_hot": ml_one_hot,
        "ml_assemble": vector_entries,
        "ml_class_weights": ml_class_weights,
        "ml_logistic_fit": ml_logistic_fit,
        "ml_forest_fit": ml_forest_fit,
        "ml_predict": ml_predict,
        "ml_classification_report": ml_classification_report,
        "ml_confusion_matrix": ml_confusion_matrix,
        "ml_roc_auc": ml_roc_auc,
        "ml_average_precision": ml_average_precision,
        "ml_model_comparison": ml_model_comparison,
        "ml_coefficients": ml_coefficients,
        "ml_top_signed_coefficients": ml_top_signed_coefficients,
        "ml_permutation_importance": ml_permutation_importance,
        "ml_pr_curve": ml_pr_curve,
        "ml_threshold_f1": ml_threshold_f1,
        "ml_model_classification_report": on_models(
            lambda scored: evaluate.classification_report(scored, LABEL)
        ),
        "ml_model_confusion_matrix": on_models(
            lambda scored: evaluate.confusion_matrix(scored, LABEL)
        ),
        "ml_model_measures": on_models(model_measures),
        "ml_model_pr_curve": logistic_curve,
        "ml_model_threshold_f1": lambda spark, sf: evaluate.threshold_f1(logistic_curve(spark, sf)),
        "ml_model_support": ml_model_support,
        "ml_predict_rows": ml_predict_rows,
        "ml_logistic_optimum": ml_logistic_optimum,
        "ml_forest_slots": ml_forest_slots,
        "ml_predict_agreement": ml_predict_agreement,
        "ml_forest_nodes": ml_forest_nodes,
        "ml_forest_node_importance": ml_forest_node_importance,
        "ml_importance_fixed_score": ml_importance_fixed_score,
        "ml_comparison_fixed_score": ml_comparison_fixed_score,
        "ml_signed_slots": ml_signed_slots,
    }
    return found
