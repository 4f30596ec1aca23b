"""Named queries over the given tables, one or more per operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from variform.functions.columns import words
from variform.operators import (
    cleaning,
    codes,
    corpus,
    distance,
    diverse,
    geo,
    groups,
    metrics,
    reports,
    sampling,
    sets,
)
from variform.operators.sampling import Draw
from variform.plans.bindings import BINARY_FEATURES, FEATURES, MULTI_VALUE, Tables
from variform.plans import workflows
from variform.plans.methods import Inputs
from variform.plans.sweep import sizes, sweep
from variform.session import stage

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

MIN_COVERAGE = 0.75
SWEEP = dict(ks=sizes(4, 12, 4), runs=3)
DRAWS = [Draw(run, k, run + k) for k in (3, 6, 40) for run in range(2)]


def query(build: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
    QUERIES[build.__name__] = lambda spark, sf_dir: build(Tables(spark, sf_dir))
    return build


def r6(c: Column | str) -> Column:
    """Doubles are compared to six digits; adding zero turns a negative zero into zero."""
    return F.round(F.col(c) if isinstance(c, str) else c, 6) + F.lit(0.0)


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: r6(c) for c in columns})


def inputs(t: Tables) -> Inputs:
    return Inputs(t.items(), families=t.families(), genera=t.genera(), counts=t.counts(), copies=True)


def _place_relation(t: Tables) -> DataFrame:
    """Kilometres between all distinct places, both directions, computed once."""
    return stage(distance.symmetrize(geo.geo_distances(t.places())))


# --- cleaning -----------------------------------------------------------------------------------


@query
def clean_features(t):
    return t.clean_features()


@query
def select_features(t):
    wide = cleaning.select_features(t.clean_features(), ("GB065", "GB001"))
    return wide.select("id", *cleaning.feature_columns(wide, prefix="GB0"))


@query
def select_items(t):
    return cleaning.select_items(t.clean_features(), t.taxed_parts())


@query
def binarize_features(t):
    return t.binary_features()


@query
def drop_macro_items(t):
    return cleaning.drop_macro_items(t.binary_features(), t.taxonomy())


@query
def crop_coverage(t):
    return cleaning.crop_coverage(t.binary_features(), MIN_COVERAGE)


@query
def crop_coverage_inclusive(t):
    return cleaning.crop_coverage(t.clean_features(), 0.8, inclusive=True)


@query
def prepared_features(t):
    return cleaning.prepare_features(
        t.raw_features(), FEATURES, t.taxed_parts(), MULTI_VALUE, t.taxonomy(), MIN_COVERAGE
    )


@query
def integral_features(t):
    return cleaning.integral_columns(t.binary_features(), BINARY_FEATURES)


@query
def cleaning_report(t):
    return cleaning.cleaning_report(t.raw_features(), FEATURES, t.taxed_parts(), MULTI_VALUE, t.taxonomy(), MIN_COVERAGE)


@query
def feature_long(t):
    return cleaning.to_long(t.binary_features(), BINARY_FEATURES)


@query
def feature_value_domain(t):
    return groups.feature_value_domain(cleaning.to_long(t.clean_features(), FEATURES))


# --- distances ----------------------------------------------------------------------------------


@query
def dist_nan_euclidean(t):
    return rounded(distance.all_pairs(t.items()), "d")


@query
def dist_normalized(t):
    return rounded(distance.normalize(distance.all_pairs(t.items())), "d").select("a", "b", "d")


@query
def dist_euclidean(t):
    """Plain Euclidean distance between the distinct (brand, type) points of all parts."""
    brand_no = F.substring("p_brand", 7, 10).cast("double")
    points = t.part.select(F.col("p_partkey").alias("id"), F.array(brand_no, F.length("p_type").cast("double")).alias("x"))
    return rounded(distance.all_pairs(points), "d")


@query
def dist_pair_lookup(t):
    return rounded(distance.pair_distances(t.neighbours_in_orders(), t.items()), "d")


@query
def dist_row_sum(t):
    return rounded(distance.row_sums(t.points()), "sum_d").select("id", "sum_d")


@query
def dist_row_sum_profiles(t):
    return rounded(distance.row_sums(t.items()), "sum_d")


@query
def dist_wide_roundtrip(t):
    """The square table of all places and back; places are few whatever the number of customers."""
    relation = _place_relation(t)
    ends = relation.select(F.col("a").alias("id")).distinct()
    square = relation.unionByName(ends.select(F.col("id").alias("a"), F.col("id").alias("b"), F.lit(0.0).alias("d")))
    ids = [r["id"] for r in ends.orderBy("id").limit(distance.PIVOT_LIMIT + 1).collect()]
    return rounded(distance.from_wide(distance.to_wide(square, ids)), "d")


@query
def sub_distances(t):
    """Relation of places restricted to a frame: places of the customers with a balance above 5000."""
    relation = _place_relation(t)
    known = relation.select(F.col("a").alias("id")).distinct()
    rich = t.customer.where("c_acctbal > 5000").select(F.col("c_custkey").alias("id"))
    frame = known.join(rich, "id", "left_semi").withColumn("pos", -F.col("id"))
    return rounded(distance.sub_distances(relation, frame), "d")


@query
def running_overlap(t):
    return rounded(distance.running_overlap(t.neighbours_in_orders(), t.items()), "overlap")


# --- sampling -----------------------------------------------------------------------------------


@query
def sample_random(t):
    return sampling.random_draws(t.items().select("id"), DRAWS)


@query
def sample_family(t):
    return sampling.stratified_draws(t.families(), "group", DRAWS, "random_family")


@query
def sample_genus(t):
    return sampling.stratified_draws(t.genera(), "group", DRAWS, "random_genus")


@query
def sample_convenience(t):
    return sampling.convenience_draws(t.items().select("id"), t.counts(), DRAWS)


@query
def sample_members(t):
    drawn = sampling.sorted_members(sampling.random_draws(t.items().select("id"), DRAWS))
    return drawn.withColumn("ids", F.array_join(F.transform("ids", lambda i: i.cast("string")), ","))


@query
def random_split(t):
    verses = t.verses().select("verse_id").distinct()
    return sampling.random_split(verses, 5, 0)


@query
def sample_maxsum(t):
    return diverse.sample_maxsum(t.points(), 10)


@query
def sample_maxmin(t):
    return diverse.sample_maxmin(t.points(), 10)


@query
def sample_maxsum_categorical(t):
    return diverse.sample_maxsum(t.items(), 8, copies=True)


@query
def sample_maxmin_categorical(t):
    return diverse.sample_maxmin(t.items(), 8, copies=True)


@query
def sample_expand(t):
    chosen = sampling.random_split(t.points().select("id"), 20, 7)
    return diverse.expand_sample(t.points(), chosen, 5)


@query
def sample_expand_framed(t):
    """Additions come from a frame that need not hold the sample."""
    chosen = sampling.random_split(t.points().select("id"), 20, 7)
    frame = t.point_labels().where("group < 5").select("id", F.col("id").alias("pos"))
    return diverse.expand_sample(t.points(), chosen, 5, frame)


@query
def expand_dataset(t):
    """Next best points for a dataset, and the metrics before and after as rows of one table."""
    dataset = sampling.random_split(t.points().select("id"), 20, 7)
    added, scores = workflows.expand_dataset(t.points(), dataset, 5)
    picks = added.select(F.lit("pick").alias("what"), F.col("pick_order").cast("bigint").alias("id"), F.col("id").cast("double").alias("value"))
    mpd = scores.select(F.col("method").alias("what"), F.lit(0).cast("bigint").alias("id"), F.col("mpd").alias("value"))
    return rounded(picks.unionByName(mpd), "value")


@query
def sample_from_relation_maxsum(t):
    return diverse.sample_from_distances(_place_relation(t), 6, "maxsum")


@query
def sample_from_relation_maxmin(t):
    return diverse.sample_from_distances(_place_relation(t), 6, "maxmin")


@query
def within_sample_distance(t):
    return rounded(distance.within_sample_distance(t.point_labels(), t.points(), "group"), "sum_d")


@query
def summed_distance_to_set(t):
    chosen = t.points().join(sampling.random_split(t.points().select("id"), 20, 7), "id", "left_semi")
    return rounded(distance.summed_distance_to_set(t.points(), chosen), "score")


@query
def min_distance_to_set(t):
    chosen = t.points().join(sampling.random_split(t.points().select("id"), 20, 7), "id", "left_semi")
    return rounded(distance.min_distance_to_set(t.points(), chosen), "score")


# --- metrics ------------------------------------------------------------------------------------


def _by_family(t) -> DataFrame:
    """Every family as one sample of all its parts."""
    return t.families().where("group is not null").join(t.items(), "id").select("group", "id", "x")


@query
def metric_mpd(t):
    return rounded(metrics.mean_pairwise_distance(_by_family(t), "group"), "mpd")


@query
def metric_fvo(t):
    return rounded(metrics.feature_value_overlap(_by_family(t), "group"), "fvo")


@query
def metric_entropy_with_missing(t):
    return rounded(metrics.value_metrics(_by_family(t), "group"), "entropy_with_missing").select("group", "entropy_with_missing")


@query
def metric_entropy_without_missing(t):
    values = rounded(metrics.value_metrics(_by_family(t), "group"), "entropy_without_missing")
    return values.select("group", "entropy_without_missing")


@query
def metric_fvi(t):
    return rounded(metrics.value_metrics(_by_family(t), "group"), "fvi").select("group", "fvi")


@query
def evaluate_samples(t):
    samples = sampling.random_draws(t.items().select("id"), DRAWS)
    whole = distance.distance_range(t.items())
    return rounded(metrics.evaluate(samples, t.items(), whole), *metrics.METRICS)


@query
def sweep_results(t):
    return rounded(sweep(inputs(t), **SWEEP), *metrics.METRICS)


@query
def sweep_unframed(t):
    """Groups and counts name parts without features, which no method may draw."""
    known = Inputs(t.items().join(t.taxed_parts(), "id", "left_semi"), families=t.families(), genera=t.genera(), counts=t.counts(), copies=True)
    return rounded(sweep(known, **SWEEP), *metrics.METRICS)


@query
def sweep_summary(t):
    summary = reports.summarize_runs(sweep(inputs(t), with_members=False, **SWEEP))
    columns = [f"{m}_{s}" for m in metrics.METRICS for s in ("mean", "std")]
    return rounded(summary, *columns)


@query
def relation_mpd(t):
    """Mean distance of samples of places, looked up in the relation."""
    relation = _place_relation(t)
    places = relation.select(F.col("a").alias("id")).distinct()
    samples = sampling.random_draws(places, [Draw(0, 5, 5), Draw(1, 5, 6)])
    return rounded(metrics.relation_mpd(samples, relation, "run"), "mpd")


# --- groups and neighbours ----------------------------------------------------------------------

DOCUMENT_FEATURES = ["quality", "toxic", "length", "lines"]


def _overlaps(t) -> DataFrame:
    documents = t.document_features()
    family = groups.group_feature_overlap(documents, DOCUMENT_FEATURES, "lang", "family")
    return family.unionByName(groups.group_feature_overlap(documents, DOCUMENT_FEATURES, "source", "genus"))


@query
def group_overlap_family(t):
    parts = t.gappy_features().join(t.families(), "id")
    return rounded(groups.group_feature_overlap(parts, list(FEATURES), "group", "family", t.families()), "avg_overlap")


@query
def group_overlap_genus(t):
    parts = t.gappy_features().join(t.genera(), "id")
    return rounded(groups.group_feature_overlap(parts, list(FEATURES), "group", "genus", t.genera()), "avg_overlap")


@query
def group_overlap_documents(t):
    return rounded(_overlaps(t), "avg_overlap")


@query
def overlap_histogram(t):
    return reports.overlap_histogram(_overlaps(t), 0.02)


@query
def top_groups(t):
    return rounded(reports.top_groups(_overlaps(t), "genus", 10), "avg_overlap")


@query
def group_sizes(t):
    return groups.group_sizes(t.genera(), "group")


@query
def group_members(t):
    return groups.group_members(t.families(), "group")


@query
def ungrouped_items(t):
    return t.families().where(F.col("group").isNull()).select("id")


@query
def nearest_with_ties(t):
    return rounded(groups.nearest_with_ties(t.items()), "nearest_d")


@query
def neighbour_group_purity(t):
    return groups.neighbour_group_purity(t.items().join(t.families(), "id"), "group")


# --- frames -------------------------------------------------------------------------------------


def _frames(t) -> tuple[DataFrame, DataFrame, DataFrame]:
    return (
        t.taxed_parts(),
        t.families().where("group is not null").select("id"),
        t.genera().where("group is not null").select("id"),
    )


@query
def frame_intersect(t):
    return sets.intersect(*_frames(t))


@query
def frame_intersect_count(t):
    return sets.intersect(*_frames(t)).agg(F.count(F.lit(1)).alias("n"))


@query
def frame_difference(t):
    taxed, family, _ = _frames(t)
    return sets.difference(family, taxed)


@query
def frame_union(t):
    taxed, _, genus = _frames(t)
    return sets.union(taxed, genus)


@query
def frame_union_tagged(t):
    taxed, family, genus = _frames(t)
    tagged = sets.union_tagged("frame", taxed=taxed, family=family, genus=genus.withColumn("extra", F.lit(1)))
    return tagged.select("frame", "id", "extra")


@query
def dataset_coverage(t):
    return sets.dataset_coverage(t.lineitem.select(F.col("l_partkey").alias("id")), t.taxed_parts())


@query
def duplicate_ids(t):
    return sets.duplicates(t.lineitem, "l_orderkey")


# --- codes --------------------------------------------------------------------------------------


@query
def map_codes(t):
    taxonomy = t.code_taxonomy()
    first = codes.dedupe_codes(taxonomy, "code", "id", "row").withColumnRenamed("target", "first_id")
    last = codes.dedupe_codes(taxonomy, "code", "id", "row", keep="last").withColumnRenamed("target", "last_id")
    return codes.map_codes(codes.map_codes(t.code_rows(), "code", first), "code", last).select("item", "code", "first_id", "last_id")


@query
def unmapped_codes(t):
    return codes.unmapped_codes(t.code_rows(), "code", codes.dedupe_codes(t.code_taxonomy(), "code", "id", "row"))


@query
def code_names(t):
    rows = t.customer.select("c_custkey", F.col("c_nationkey").cast("string").alias("id"))
    return codes.names(rows, t.code_taxonomy()).select("c_custkey", "id", "name")


# --- places -------------------------------------------------------------------------------------


@query
def geo_distances(t):
    return rounded(geo.geo_distances(t.places()), "d")


@query
def geo_symmetrized(t):
    return rounded(distance.symmetrize(geo.geo_distances(t.places())), "d")


@query
def geo_pair_kilometres(t):
    """Distance between the places of consecutive customers."""
    pairs = t.customer.select(F.col("c_custkey").alias("a"), (F.col("c_custkey") + 1).alias("b"))
    return rounded(geo.pair_kilometres(pairs, t.places()), "d")


# --- corpus -------------------------------------------------------------------------------------


@query
def unit_frequency(t):
    return corpus.unit_frequency(t.verses())


@query
def largest_edition(t):
    return corpus.largest_edition(t.verses())


def _chosen(t) -> tuple[DataFrame, DataFrame]:
    verses = t.verses()
    best = corpus.chosen_editions(verses, corpus.largest_edition(verses))
    return best, corpus.most_common_units(best, 4)


@query
def most_common_units(t):
    return _chosen(t)[1]


@query
def fully_covering(t):
    verses = t.verses()
    return corpus.fully_covering(verses, corpus.most_common_units(verses, 4))


@query
def selected_units(t):
    verses = t.verses()
    common = corpus.most_common_units(verses, 4)
    return corpus.selected_units(verses, common, corpus.fully_covering(verses, common))


@query
def parallel_text(t):
    """The whole chain over the largest edition of each language."""
    return workflows.select_parallel_text(t.verses(), 6, 3, 1)


@query
def avg_tokens(t):
    return rounded(corpus.avg_tokens(corpus.text_lines(t.documents), "lang"), "avg_subwords")


@query
def avg_tokens_conversations(t):
    return rounded(corpus.avg_tokens(t.conversations, "role"), "avg_subwords")


def _document_cost(t) -> DataFrame:
    return t.documents.select(F.col("doc_id").alias("id"), "lang", words("text").alias("score"))


@query
def token_summary(t):
    """Distribution of document length by language, and over all documents."""
    scores = _document_cost(t)
    everything = scores.withColumn("lang", F.explode(F.array("lang", F.lit("All"))))
    quartiles = [f"q{int(q * 100)}" for q in reports.QUARTILES]
    return rounded(reports.distribution_summary(everything, "lang"), *quartiles)


@query
def cost_of_members(t):
    samples = sampling.random_draws(t.documents.select(F.col("doc_id").alias("id")), DRAWS)
    return corpus.cost_of_members(samples, _document_cost(t)).select("run", "k", "id", "score")


@query
def results_by_label(t):
    """Sweep results under display names, one row per member of the samples of size 4 and run 0."""
    results = reports.slice_results(sweep(inputs(t), **SWEEP), ks=[4], methods=["maxsum", "maxmin"], run=0)
    return reports.explode_sample(reports.relabel(results)).select("Method", "run", "k", "id")


from variform.plans import files  # noqa: E402, F401  registers the queries that write files and read them
