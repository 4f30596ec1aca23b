"""Plain SQL for each query, written item by item: self-joins, windows and recursion over whole tables."""

from __future__ import annotations

from variform.plans.bindings import BINARY_FEATURES, FEATURES
from variform.plans.catalogue import DRAWS, MIN_COVERAGE, SWEEP
from variform.operators.metrics import METRICS
from variform.operators.sampling import draws_for

_VALUES = {
    "GB001": "CASE WHEN p_type IN ('LARGE', 'PROMO', 'STANDARD') THEN 1 ELSE 0 END",
    "GB024": "CAST(substr(p_brand, 7) AS INTEGER) % 4",
    "GB030": "CASE WHEN p_size > 25 THEN 1 ELSE 0 END",
    "GB065": "CAST(floor((p_retailprice - 900) / 25) AS INTEGER)",
    "GB074": "p_size % 2",
}
RAW = "raw AS (SELECT p_partkey AS id, " + ", ".join(
    f"CASE WHEN (p_partkey + {j}) % 11 = 0 THEN 'no_cov' WHEN (p_partkey + {j}) % 7 = 0 THEN '?' "
    f"ELSE CAST({_VALUES[f]} AS VARCHAR) END AS {f}"
    for j, f in enumerate(FEATURES, 1)
) + " FROM part)"
CLEAN = RAW + ", clean AS (SELECT id, " + ", ".join(
    f"CASE WHEN {f} IN ('no_cov', '?', 'nan', '') THEN NULL ELSE CAST({f} AS DOUBLE) END AS {f}" for f in FEATURES
) + " FROM raw)"


def _split(f: str) -> str:
    return ", ".join(
        f"CASE WHEN {f} IS NULL THEN NULL WHEN {f} IN ({n}, 3) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS {f}_{n}" for n in (1, 2)
    )


BIN = CLEAN + f", bin AS (SELECT id, GB001, GB030, GB074, {_split('GB024')}, {_split('GB065')} FROM clean)"
BIN = BIN.replace("bin AS (", "bin AS MATERIALIZED (")
LONG = BIN + ", long AS MATERIALIZED (" + " UNION ALL ".join(
    f"SELECT id, {i} AS pos, '{f}' AS feature, {f} AS val FROM bin" for i, f in enumerate(BINARY_FEATURES)
) + ")"
FAMILY = "family AS (SELECT p_partkey AS id, CASE WHEN p_size <> 13 THEN p_type END AS grp FROM part)"
GENUS = "genus AS (SELECT p_partkey AS id, CASE WHEN p_size <> 7 THEN p_brand END AS grp FROM part)"
COUNTS = "counts AS (SELECT l_partkey AS id, count(*) AS n FROM lineitem GROUP BY 1)"
TAXED = "taxed AS (SELECT DISTINCT l_partkey AS id FROM lineitem WHERE l_tax >= 0.08 AND l_quantity >= 40)"
TAXONOMY = (
    "taxonomy AS (SELECT l_partkey AS id, count(*) FILTER (WHERE l_returnflag = 'R' AND l_quantity > 45) AS children "
    "FROM lineitem GROUP BY 1)"
)
NEAR = (
    "near AS (SELECT DISTINCT least(l.l_partkey, f.l_partkey) AS a, greatest(l.l_partkey, f.l_partkey) AS b "
    "FROM lineitem l JOIN lineitem f ON l.l_orderkey = f.l_orderkey AND f.l_linenumber = l.l_linenumber + 1 "
    "WHERE l.l_partkey <> f.l_partkey)"
)
POINTS = "pt AS MATERIALIZED (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings)"
PLACES = (
    "place AS (SELECT c_custkey AS id, "
    "CASE WHEN c_nationkey <> 24 THEN c_nationkey * 6.5::DOUBLE - 72.25::DOUBLE + (ascii(c_mktsegment) % 5) * 0.75::DOUBLE END AS lat, "
    "CASE WHEN c_nationkey <> 24 THEN (c_nationkey * 47) % 360 - 180 + ascii(c_mktsegment) * 0.31::DOUBLE END AS lon FROM customer), "
    "site AS MATERIALIZED (SELECT min(id) AS id, count(*) AS w, lat, lon FROM place GROUP BY lat, lon)"
)
VERSES = (
    "verse AS (SELECT user_id AS lang, CAST(floor((day(ts) - 1) / 7) AS INTEGER) AS edition, "
    "event_type || '/' || CAST(json_extract_string(props, '$.k') AS INTEGER) // 10 AS verse_id, "
    "props || ' ' || CAST(value AS VARCHAR) AS text, event_id AS line FROM events)"
)
COMMON = (
    "common AS (SELECT verse_id, count(*) AS n_editions FROM (SELECT DISTINCT lang, edition, verse_id FROM verse) "
    "GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 4)"
)


def _nan_euclid(a: str = "a", b: str = "b") -> str:
    total = " + ".join(f"coalesce(({a}.{f} - {b}.{f}) * ({a}.{f} - {b}.{f}), 0)" for f in BINARY_FEATURES)
    shared = " + ".join(f"CASE WHEN {a}.{f} IS NULL OR {b}.{f} IS NULL THEN 0 ELSE 1 END" for f in BINARY_FEATURES)
    return f"CASE WHEN ({shared}) = 0 THEN 0 ELSE sqrt(({total}) * {len(BINARY_FEATURES)}.0::DOUBLE / ({shared})) END"


def _km(a: str, b: str) -> str:
    """Lambert's formula on one row per pair, NULL-safe: missing coordinates give 0."""
    f, radius = "(1 / 298.257223563::DOUBLE)", "6378.137::DOUBLE"
    return (
        f"(SELECT CASE WHEN h IS NULL THEN 0.0 WHEN h = 0 THEN 0.0 WHEN h > 1 - 1e-6 THEN {radius} * s ELSE {radius} * (s - {f} / 2 * ("
        "(s - sin(s)) * pow(sin(p), 2) * pow(cos(q), 2) / pow(cos(s / 2), 2) + "
        "(s + sin(s)) * pow(cos(p), 2) * pow(sin(q), 2) / pow(sin(s / 2), 2))) END FROM ("
        "SELECT h, 2 * asin(sqrt(h)) AS s, (b1 + b2) / 2 AS p, (b2 - b1) / 2 AS q FROM ("
        "SELECT b1, b2, least(greatest(pow(sin((b2 - b1) / 2), 2) + cos(b1) * cos(b2) * pow(sin(dl / 2), 2), 0), 1) AS h, FROM ("
        f"SELECT atan((1 - {f}) * tan(radians({a}.lat))) AS b1, atan((1 - {f}) * tan(radians({b}.lat))) AS b2, "
        f"radians({b}.lon - {a}.lon) AS dl)))) "
    )


PAIRS = BIN + f", pairs AS MATERIALIZED (SELECT a.id AS a, b.id AS b, {_nan_euclid()} AS d FROM bin a, bin b)"
_SAME_VECTOR = ", ".join(BINARY_FEATURES)
PROFILES = BIN + f", prof AS MATERIALIZED (SELECT min(id) AS id, count(*) AS w, {_SAME_VECTOR} FROM bin GROUP BY {_SAME_VECTOR})"
PROFILE_PAIRS = (
    f"SELECT a.id AS a, b.id AS b, {_nan_euclid()} AS d, a.w AS n_a, b.w AS n_b FROM prof a JOIN prof b ON a.id < b.id"
)
POINT_PAIRS = POINTS + ", pairs AS MATERIALIZED (SELECT a.id AS a, b.id AS b, list_distance(a.x, b.x) AS d FROM pt a, pt b)"
SITE_PAIRS = PLACES + f", pairs AS MATERIALIZED (SELECT a.id AS a, b.id AS b, {_km('a', 'b')} AS d FROM site a, site b WHERE a.id <> b.id)"


def _greedy(k: int, how: str) -> str:
    """Recursive CTE: a list of picks, extended by the best remaining item; ties to the smallest id."""
    return (
        "picked AS (SELECT 1 AS step, [(SELECT min(a) FROM (SELECT a, sum(d) AS s, max(sum(d)) OVER () AS top FROM pairs GROUP BY a) "
        "WHERE s >= top - abs(top) * 1e-12)] AS picks "
        "UNION ALL SELECT step + 1, list_append(picks, (SELECT b FROM pairs WHERE list_contains(picks, a) "
        f"AND NOT list_contains(picks, b) GROUP BY b ORDER BY round({how}(d), 9) DESC, b LIMIT 1)) FROM picked WHERE step < {k})"
    )


_PICK_ROWS = (
    "SELECT CAST(i AS INTEGER) AS pick_order, picks[i] AS id FROM (SELECT picks, unnest(range(1, len(picks) + 1)) AS i "
    "FROM picked WHERE step = {k})"
)


def _sample_greedy(pairs: str, k: int, how: str) -> str:
    return f"WITH RECURSIVE {pairs}, {_greedy(k, how)} {_PICK_ROWS.format(k=k)}"


def _h(salt: str | None = None) -> str:
    parts = ["seed", *([f"'{salt}'"] if salt else []), "id"]
    return f"md5(concat_ws('|', {', '.join(parts)}))"


def _draws(draws) -> str:
    return "draws AS (SELECT * FROM (VALUES " + ", ".join(f"({d.run}, {d.k}, {d.seed})" for d in draws) + ") v(run, k, seed))"


def _random(source: str) -> str:
    return (
        f"SELECT 'random' AS method, run, k, id FROM (SELECT run, k, id, row_number() OVER (PARTITION BY run, k ORDER BY {_h()}, id) AS rn "
        f"FROM draws, (SELECT id FROM {source})) WHERE rn <= k"
    )


def _stratified(source: str, method: str) -> str:
    return (
        f"SELECT '{method}' AS method, run, k, id FROM (SELECT run, k, id, row_number() OVER (PARTITION BY run, k ORDER BY tier, h, id) AS place FROM ("
        "SELECT run, k, id, CASE WHEN grp IS NOT NULL AND rn <= CASE WHEN groups < k THEN k // n_groups ELSE 1 END THEN 0 ELSE 1 END AS tier, "
        f"CASE WHEN grp IS NOT NULL AND rn <= CASE WHEN groups < k THEN k // n_groups ELSE 1 END THEN {_h('group')} ELSE {_h('fill')} END AS h "
        f"FROM (SELECT *, row_number() OVER (PARTITION BY run, k, grp ORDER BY {_h()}, id) AS rn FROM draws, {source}), "
        f"(SELECT count(DISTINCT grp) AS groups, count(DISTINCT grp) + max(CASE WHEN grp IS NULL THEN 1 ELSE 0 END) AS n_groups FROM {source}))) "
        "WHERE place <= k"
    )


def _convenience() -> str:
    return (
        "SELECT 'convenience' AS method, run, k, id FROM (SELECT run, k, id, "
        f"row_number() OVER (PARTITION BY run, k ORDER BY n DESC, {_h()}, id) AS rn FROM draws, counts WHERE id IN (SELECT p_partkey FROM part)) WHERE rn <= k"
    )


def _metrics(samples: str, keys: str, range_pairs: str) -> str:
    """CTEs that score ``samples(keys.., id)``: pairs within a sample for mpd and fvo, counts per value for the rest."""
    eq = " AND ".join(f"l.{c} = r.{c}" for c in keys.split(", "))
    lk = ", ".join(f"l.{c}" for c in keys.split(", "))
    return (
        f"smp AS MATERIALIZED ({samples}), "
        f"duo AS MATERIALIZED (SELECT {lk}, l.id AS a, r.id AS b FROM smp l JOIN smp r ON {eq} AND l.id < r.id), "
        f"span AS (SELECT max(d) AS hi FROM ({range_pairs})), "
        f"m_mpd AS (SELECT {keys}, avg({_nan_euclid('x', 'y')}) / any_value(hi) AS mpd FROM duo JOIN bin x ON x.id = a JOIN bin y ON y.id = b, span GROUP BY {keys}), "
        f"steps AS (SELECT {keys}, a, b, sum(CASE WHEN x.val = y.val THEN 1 ELSE 0 END) OVER w AS same, "
        "sum(CASE WHEN x.val IS NULL OR y.val IS NULL THEN 0 ELSE 1 END) OVER w AS total "
        f"FROM duo JOIN long x ON x.id = a JOIN long y ON y.id = b AND y.pos = x.pos WINDOW w AS (PARTITION BY {keys}, a, b ORDER BY x.pos)), "
        f"m_fvo AS (SELECT {keys}, avg(same / total) AS fvo FROM steps WHERE total > 0 GROUP BY {keys}), "
        f"cell AS (SELECT {keys}, pos, val, count(*) AS c FROM smp JOIN long USING (id) GROUP BY {keys}, pos, val), "
        f"shares AS (SELECT {keys}, pos, val, c / sum(c) OVER (PARTITION BY {keys}, pos) AS p_all, "
        f"c / sum(CASE WHEN val IS NOT NULL THEN c END) OVER (PARTITION BY {keys}, pos) AS p_known FROM cell), "
        f"feat AS (SELECT {keys}, pos, round(-sum(p_all * log2(p_all)), 10) AS e_all, "
        "round(coalesce(-sum(CASE WHEN val IS NOT NULL THEN p_known * log2(p_known) END), 0), 10) AS e_known, "
        f"count(val) / 2 AS incl FROM shares GROUP BY {keys}, pos), "
        f"m_val AS (SELECT {keys}, avg(e_all) AS entropy_with_missing, avg(e_known) AS entropy_without_missing, avg(incl) AS fvi FROM feat GROUP BY {keys})"
    )


def _scored(keys: str) -> str:
    picked = ", ".join(f"round({m}, 6) + 0.0 AS {m}" for m in METRICS)
    members = f"(SELECT {keys}, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) AS sample FROM smp GROUP BY {keys})"
    return f"SELECT {keys}, {picked}, sample FROM m_val JOIN m_mpd USING ({keys}) JOIN m_fvo USING ({keys}) JOIN {members} USING ({keys})"


KEYS = "method, run, k"
_SWEEP_DRAWS = draws_for(SWEEP["ks"], SWEEP["runs"])


def _sweep_ctes(known: str = "") -> str:
    """``known`` is a condition on the ids of items that have features; groups and counts may name others."""
    k_max, sizes = max(SWEEP["ks"]), ", ".join(f"({k})" for k in SWEEP["ks"])
    greedy = []
    for method, how in (("maxsum", "sum"), ("maxmin", "min")):
        greedy.append(
            f"{method} AS MATERIALIZED ({_PICK_ROWS.format(k=k_max).replace('picked', method + '_picked')})"
        )
    walks = ", ".join(
        _greedy(k_max, how).replace("picked", f"{method}_picked") for method, how in (("maxsum", "sum"), ("maxmin", "min"))
    )
    samples = [
        f"SELECT '{m}' AS method, 0 AS run, k, id FROM {m}, (VALUES {sizes}) v(k) WHERE pick_order <= k" for m in ("maxsum", "maxmin")
    ]
    samples += [_random("bin"), _stratified("family", "random_family"), _stratified("genus", "random_genus"), _convenience()]
    # the recursion needs the relation of all items, of which only the largest distance is used later
    base = LONG + f", pairs AS MATERIALIZED (SELECT a.id AS a, b.id AS b, {_nan_euclid()} AS d FROM bin a, bin b)"
    whole = (
        f"WITH RECURSIVE {base}, {FAMILY}, {GENUS}, {COUNTS}, {_draws(_SWEEP_DRAWS)}, {walks}, {', '.join(greedy)}, "
        + _metrics(" UNION ALL ".join(samples), KEYS, "SELECT d FROM pairs")
    )
    if known:
        has = "IN (SELECT id FROM bin)"
        whole = whole.replace(f"{_split('GB065')} FROM clean)", f"{_split('GB065')} FROM clean WHERE {known})")
        whole = whole.replace("AS grp FROM part)", f"AS grp FROM part WHERE p_partkey {has})").replace("IN (SELECT p_partkey FROM part)", has)
        whole = whole.replace("WITH RECURSIVE ", f"WITH RECURSIVE {TAXED}, ")
    return whole


def _overlap_counts(features: list[str], source: str, group: str, method: str, groups: str | None = None) -> str:
    """Mean share of equal raw values over all pairs within a group, pair by pair; groups without members too."""
    share = " + ".join(f"CASE WHEN l.{f} = r.{f} THEN 1 ELSE 0 END" for f in features)
    return (
        f"SELECT '{method}' AS method, g.{group} AS \"group\", coalesce(o.avg_overlap, 0) AS avg_overlap, coalesce(c.n, 0) AS n_members FROM "
        f"(SELECT DISTINCT {group} FROM {groups or source} WHERE {group} IS NOT NULL) g LEFT JOIN "
        f"(SELECT {group}, count(*) AS n FROM {source} GROUP BY 1) c ON c.{group} = g.{group} LEFT JOIN "
        f"(SELECT l.{group}, avg(({share}) / {len(features)}.0) AS avg_overlap FROM {source} l JOIN {source} r "
        f"ON l.{group} = r.{group} AND l.id < r.id GROUP BY 1) o ON o.{group} = g.{group}"
    )


DOCS = (
    "docs AS MATERIALIZED (SELECT doc_id AS id, coalesce(CAST(quality AS VARCHAR), '?') AS quality, coalesce(CAST(toxic AS VARCHAR), '?') AS toxic, "
    "CASE WHEN n_chars > 500 THEN '1' ELSE '0' END AS length, "
    "CAST(length(text) - length(replace(text, chr(10), '')) AS VARCHAR) AS lines, lang, source "
    "FROM documents LEFT JOIN labels USING (doc_id))"
)
_DOC_FEATURES = ["quality", "toxic", "length", "lines"]
OVERLAPS = (
    f"{DOCS}, ovl AS MATERIALIZED ({_overlap_counts(_DOC_FEATURES, 'docs', 'lang', 'family')} "
    f"UNION ALL {_overlap_counts(_DOC_FEATURES, 'docs', 'source', 'genus')})"
)


def _part_overlap(groups: str, table: str, method: str) -> str:
    columns = ", ".join("CASE WHEN raw.id % 13 <> 0 THEN GB024 END AS GB024" if f == "GB024" else f for f in FEATURES)
    gone = "SELECT p_partkey FROM part WHERE p_type = 'PROMO' OR p_brand = 'Brand#11'"
    joined = f"member AS MATERIALIZED (SELECT id, {columns}, grp FROM raw JOIN {table} USING (id) WHERE id NOT IN ({gone}))"
    body = _overlap_counts(list(FEATURES), "member", "grp", method, table)
    return f"WITH {RAW}, {groups}, {joined} SELECT method, \"group\", round(avg_overlap, 6) AS avg_overlap, n_members FROM ({body})"


def _by_family(select: str) -> str:
    samples = "SELECT grp AS \"group\", id FROM family WHERE grp IS NOT NULL"
    ctes = _metrics(samples, "grp", "SELECT 1 AS d").replace("SELECT grp AS \"group\", id", "SELECT grp, id")
    return f"WITH {LONG}, {FAMILY}, {ctes} {select}"


def _fvo_modes() -> str:
    modes = (
        ("every_position", "SELECT grp, avg(same / total) AS fvo FROM marks WHERE total > 0 GROUP BY 1"),
        ("shared_positions", "SELECT grp, avg(same / total) AS fvo FROM marks WHERE is_shared GROUP BY 1"),
        (
            "pair_mean",
            "SELECT grp, avg(s) AS fvo FROM (SELECT grp, a, b, max(same) / max(total) AS s FROM marks WHERE total > 0 GROUP BY grp, a, b) GROUP BY 1",
        ),
    )
    marks = (
        "marks AS MATERIALIZED (SELECT l.grp, l.id AS a, r.id AS b, x.val IS NOT NULL AND y.val IS NOT NULL AS is_shared, "
        "sum(CASE WHEN x.val = y.val THEN 1 ELSE 0 END) OVER w AS same, "
        "sum(CASE WHEN x.val IS NULL OR y.val IS NULL THEN 0 ELSE 1 END) OVER w AS total "
        "FROM family l JOIN family r ON l.grp = r.grp AND l.id < r.id JOIN long x ON x.id = l.id "
        "JOIN long y ON y.id = r.id AND y.pos = x.pos WINDOW w AS (PARTITION BY l.id, r.id ORDER BY x.pos))"
    )
    rows = " UNION ALL ".join(f"SELECT grp AS \"group\", '{name}' AS mode, round(fvo, 6) AS fvo FROM ({body})" for name, body in modes)
    return f"WITH {LONG}, {FAMILY}, {marks} {rows}"


CHOSEN = "chosen AS (SELECT id FROM (SELECT id, row_number() OVER (ORDER BY md5(concat_ws('|', 7, id)), id) AS rn FROM pt) WHERE rn <= 20)"
_WORDS = "(SELECT CASE WHEN t = '' THEN 0 ELSE len(string_split(t, ' ')) END FROM (SELECT trim(regexp_replace({text}, '[ \\t\\r\\n]+', ' ', 'g')) AS t))"
_COVERED = " + ".join(f"CASE WHEN {f} IS NULL THEN 0 ELSE 1 END" for f in BINARY_FEATURES)
_COVERED_RAW = " + ".join(f"CASE WHEN {f} IS NULL THEN 0 ELSE 1 END" for f in FEATURES)


def _report() -> str:
    n_in, n_out, share = len(FEATURES), len(BINARY_FEATURES), MIN_COVERAGE
    n = {
        "n0": "count(*)",
        "n1": "count(*) FILTER (WHERE listed)",
        "n2": "count(*) FILTER (WHERE listed AND leaf)",
        "n3": f"count(*) FILTER (WHERE listed AND leaf AND covered > {share * n_out})",
    }
    rows = (
        ("1 features", "n0", n_in, "n0", n_in),
        ("2 items", "n0", n_in, "n1", n_in),
        ("3 binarize", "n1", n_in, "n1", n_out),
        ("4 macro", "n1", n_out, "n2", n_out),
        ("5 crop", "n2", n_out, "n3", n_out),
    )
    body = " UNION ALL ".join(
        f"SELECT '{step}' AS step, {a} AS rows_before, CAST({ca} AS BIGINT) AS cols_before, {b} AS rows_after, CAST({cb} AS BIGINT) AS cols_after FROM c"
        for step, a, ca, b, cb in rows
    )
    flags = (
        f"f AS (SELECT id IN (SELECT id FROM taxed) AS listed, id IN (SELECT id FROM taxonomy WHERE children = 0) AS leaf, {_COVERED} AS covered FROM bin), "
        f"c AS (SELECT {', '.join(f'{e} AS {name}' for name, e in n.items())} FROM f)"
    )
    return f"WITH {BIN}, {TAXED}, {TAXONOMY}, {flags} {body}"


def _quartiles() -> str:
    qs = ", ".join(f"round(quantile_cont(score, {q}), 6) AS q{int(q * 100)}" for q in (0.0, 0.25, 0.5, 0.75, 1.0))
    scored = f"s AS (SELECT doc_id AS id, lang, CAST({_WORDS.format(text='text')} AS DOUBLE) AS score FROM documents)"
    return (
        f"WITH {scored} SELECT lang, count(*) AS n, {qs} FROM (SELECT lang, score FROM s UNION ALL SELECT 'All', score FROM s) GROUP BY lang"
    )


def oracles() -> dict[str, str]:
    plain = _plain()
    return {**plain, **_files(plain)}


def _files(plain: dict[str, str]) -> dict[str, str]:
    """What comes back from a file is what the table holds."""
    language, week = "'l' || lpad(CAST(user_id % 40 AS VARCHAR), 2, '0')", "CAST(floor((day(ts) - 1) / 7) AS INTEGER)"
    edition = f"{language} || '-week' || {week} || '.txt'"
    spaced = "regexp_replace(concat_ws(' ', event_type, props), '\\s+', ' ', 'g')"
    code = "'cust' || c_custkey"
    nation = "'nation' || c_nationkey"
    return {
        "file_features": plain["binarize_features"],
        "file_distances": plain["dist_wide_roundtrip"],
        "file_default_frame": f"SELECT DISTINCT a AS id FROM ({plain['geo_symmetrized']})",
        "file_frame": f"WITH {TAXED} SELECT id, id AS pos FROM taxed",
        "file_item_metadata": f"WITH {PLACES} SELECT CAST(c_custkey AS VARCHAR) AS ID, c_name AS Name, c_mktsegment AS Macroarea, round(lat, 6) + 0 AS Latitude, "
        f"round(lon, 6) + 0 AS Longitude, {code} AS Glottocode, CAST(NULL AS VARCHAR) AS ISO639P3code, 'orders, and \"quoted\"' AS provenance, "
        f"CASE WHEN c_nationkey <> 7 THEN {nation} END AS Family_name, {nation} AS Family_level_ID, {code} AS Language_level_ID, 'language' AS level, "
        f"{nation} || '/' || {code} AS lineage FROM customer JOIN place ON place.id = c_custkey",
        "file_groups": 'SELECT p_partkey AS id, CASE WHEN p_size <> 7 THEN p_brand END AS "group" FROM part',
        "file_counts": "SELECT l_partkey AS id, count(*) AS n FROM lineitem GROUP BY 1",
        "file_taxonomy": f"WITH {TAXONOMY} SELECT id, CAST(children AS INTEGER) AS child_language_count FROM taxonomy",
        "file_token_costs": f"SELECT 'verses/' || lang AS verses, avg_subwords, lang AS glottocode FROM ({plain['avg_tokens']}) "
        f"UNION ALL SELECT 'verses/' || role, avg_subwords, role FROM ({plain['avg_tokens_conversations']})",
        "file_corpus": f"SELECT {language} AS lang, {edition} AS edition, CAST(event_id AS VARCHAR) AS verse_id, {spaced} AS text FROM events",
        "file_corpus_headers": f"SELECT DISTINCT {edition} AS edition, 'c' || lpad(CAST(user_id % 40 AS VARCHAR), 2, '0') AS code, "
        "list_extract(['Latn', 'Cyrl', 'Arab'], CAST(user_id % 40 % 3 + 1 AS INTEGER)) AS script FROM events",
        "file_language_texts": f"SELECT {language} AS code, concat_ws(' ', event_type, props) AS text FROM events",
        "file_points": f"WITH {POINTS} SELECT id, len(x)::INTEGER AS width, round(x[1], 6) + 0 AS first, round(list_sum(x), 6) + 0 AS total FROM pt",
        "file_samples": plain["sample_random"],
        "file_sample_lists": f"SELECT method || '-parts-' || k || '-dists-' || (run + k) AS name, id FROM ({plain['sample_random']})",
        "file_results": plain["evaluate_samples"],
    }


def _plain() -> dict[str, str]:
    frames = f"{TAXED}, {FAMILY}, {GENUS}, f1 AS (SELECT id FROM family WHERE grp IS NOT NULL), f2 AS (SELECT id FROM genus WHERE grp IS NOT NULL)"
    codes = "code AS (SELECT 'c' || CASE WHEN n_nationkey IN (20, 21) THEN n_nationkey - 10 ELSE n_nationkey END AS code, CAST(n_nationkey AS VARCHAR) AS id, n_nationkey AS rw FROM nation)"
    first = "first AS (SELECT code, min_by(id, rw) AS first_id, max_by(id, rw) AS last_id FROM code GROUP BY 1)"
    rows = "item AS (SELECT c_custkey AS item, 'c' || (c_nationkey + 3) AS code FROM customer)"
    summary = ", ".join(
        f"round(avg({m}), 6) AS {m}_mean, round(stddev_samp(CASE WHEN method NOT IN ('maxsum', 'maxmin') THEN {m} END), 6) AS {m}_std" for m in METRICS
    )
    both_ways = "SELECT a, b, round(d, 6) AS d FROM pairs"
    labels = "CASE method WHEN 'maxsum' THEN 'MaxSum' WHEN 'maxmin' THEN 'MaxMin' WHEN 'random_genus' THEN 'RandomGenus*' WHEN 'random_family' THEN 'RandomFamily*' WHEN 'convenience' THEN 'Convenience*' WHEN 'random' THEN 'Random*' END"
    edition = (
        "ed AS (SELECT lang, edition, count(DISTINCT verse_id) AS n_verses FROM verse GROUP BY 1, 2), "
        "best AS (SELECT lang, edition, n_verses FROM ed QUALIFY row_number() OVER (PARTITION BY lang ORDER BY n_verses DESC, edition) = 1)"
    )
    covering = "cover AS (SELECT lang FROM verse WHERE verse_id IN (SELECT verse_id FROM common) GROUP BY 1 HAVING count(DISTINCT verse_id) = 4)"
    return {
        "clean_features": f"WITH {CLEAN} SELECT * FROM clean",
        "select_features": f"WITH {CLEAN} SELECT id, GB065, GB001 FROM clean",
        "select_items": f"WITH {CLEAN}, {TAXED} SELECT clean.* FROM clean WHERE id IN (SELECT id FROM taxed)",
        "binarize_features": f"WITH {BIN} SELECT * FROM bin",
        "drop_macro_items": f"WITH {BIN}, {TAXONOMY} SELECT bin.* FROM bin WHERE id IN (SELECT id FROM taxonomy WHERE children = 0)",
        "crop_coverage": f"WITH {BIN} SELECT * FROM bin WHERE {_COVERED} > {MIN_COVERAGE * len(BINARY_FEATURES)}",
        "crop_coverage_inclusive": f"WITH {CLEAN} SELECT * FROM clean WHERE {_COVERED_RAW} >= {0.8 * len(FEATURES)}",
        "prepared_features": f"WITH {BIN}, {TAXED}, {TAXONOMY} SELECT bin.* FROM bin WHERE id IN (SELECT id FROM taxed) "
        f"AND id IN (SELECT id FROM taxonomy WHERE children = 0) AND {_COVERED} > {MIN_COVERAGE * len(BINARY_FEATURES)}",
        "integral_features": f"WITH {BIN} SELECT id, " + ", ".join(f"CAST({f} AS BIGINT) AS {f}" for f in BINARY_FEATURES) + " FROM bin",
        "cleaning_report": _report(),
        "feature_long": f"WITH {LONG} SELECT id, pos, feature, val FROM long",
        "feature_value_domain": f"WITH {CLEAN} "
        + " UNION ".join(f"SELECT '{f}' AS feature, {f} AS val FROM clean WHERE {f} IS NOT NULL" for f in FEATURES),
        "dist_nan_euclidean": f"WITH {PROFILES} SELECT a, b, round(d, 6) AS d, n_a, n_b FROM ({PROFILE_PAIRS})",
        "dist_normalized": f"WITH {PROFILES}, pp AS ({PROFILE_PAIRS}) SELECT a, b, round(d / (SELECT max(d) FROM pp), 6) AS d FROM pp",
        "dist_euclidean": "WITH pt AS (SELECT min(p_partkey) AS id, count(*) AS w, CAST(substr(p_brand, 7) AS DOUBLE) AS u, CAST(length(p_type) AS DOUBLE) AS v "
        "FROM part GROUP BY 3, 4) SELECT a.id AS a, b.id AS b, round(sqrt(pow(a.u - b.u, 2) + pow(a.v - b.v, 2)), 6) AS d, a.w AS n_a, b.w AS n_b "
        "FROM pt a JOIN pt b ON a.id < b.id",
        "dist_pair_lookup": f"WITH {BIN}, {NEAR} SELECT near.a, near.b, round({_nan_euclid('x', 'y')}, 6) AS d FROM near JOIN bin x ON x.id = near.a JOIN bin y ON y.id = near.b",
        "dist_row_sum": f"WITH {POINT_PAIRS} SELECT a AS id, round(sum(d), 6) AS sum_d FROM pairs GROUP BY 1",
        "dist_row_sum_profiles": f"WITH {PAIRS}, prof AS (SELECT min(id) AS id, count(*) AS n_items FROM bin GROUP BY {_SAME_VECTOR}) "
        "SELECT a AS id, round(sum(d), 6) AS sum_d, any_value(n_items) AS n_items FROM pairs JOIN prof ON prof.id = a GROUP BY 1",
        "dist_wide_roundtrip": f"WITH {SITE_PAIRS} SELECT a, CAST(b AS VARCHAR) AS b, round(d, 6) AS d FROM "
        "(SELECT a, b, d FROM pairs UNION ALL SELECT id, id, 0.0 FROM site)",
        "sub_distances": f"WITH {SITE_PAIRS}, fr AS (SELECT site.id, -site.id AS pos FROM site JOIN customer ON c_custkey = site.id WHERE c_acctbal > 5000) "
        "SELECT a, b, round(d, 6) AS d, x.pos AS pos_a, y.pos AS pos_b FROM pairs JOIN fr x ON x.id = a JOIN fr y ON y.id = b",
        "running_overlap": f"WITH {LONG}, {NEAR} SELECT a, b, pos, round(same / total, 6) AS overlap FROM (SELECT a, b, x.pos AS pos, "
        "sum(CASE WHEN x.val = y.val THEN 1 ELSE 0 END) OVER w AS same, sum(CASE WHEN x.val IS NULL OR y.val IS NULL THEN 0 ELSE 1 END) OVER w AS total "
        "FROM near JOIN long x ON x.id = a JOIN long y ON y.id = b AND y.pos = x.pos WINDOW w AS (PARTITION BY a, b ORDER BY x.pos)) WHERE total > 0",
        "sample_random": f"WITH it AS (SELECT p_partkey AS id FROM part), {_draws(DRAWS)} {_random('it')}",
        "sample_family": f"WITH {FAMILY}, {_draws(DRAWS)} {_stratified('family', 'random_family')}",
        "sample_genus": f"WITH {GENUS}, {_draws(DRAWS)} {_stratified('genus', 'random_genus')}",
        "sample_convenience": f"WITH {COUNTS}, {_draws(DRAWS)} {_convenience()}",
        "sample_members": f"WITH it AS (SELECT p_partkey AS id FROM part), {_draws(DRAWS)} SELECT method, run, k, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) AS ids "
        f"FROM ({_random('it')}) GROUP BY 1, 2, 3",
        "random_split": f"WITH {VERSES} SELECT id FROM (SELECT id, row_number() OVER (ORDER BY md5(concat_ws('|', 0, id)), id) AS rn FROM (SELECT DISTINCT verse_id AS id FROM verse)) WHERE rn <= 5",
        "sample_maxsum": _sample_greedy(POINT_PAIRS, 10, "sum"),
        "sample_maxmin": _sample_greedy(POINT_PAIRS, 10, "min"),
        "sample_maxsum_categorical": _sample_greedy(PAIRS, 8, "sum"),
        "sample_maxmin_categorical": _sample_greedy(PAIRS, 8, "min"),
        "sample_expand": f"WITH RECURSIVE {POINT_PAIRS}, {CHOSEN}, grown AS (SELECT 0 AS step, (SELECT list(id) FROM chosen) AS picks UNION ALL "
        "SELECT step + 1, list_append(picks, (SELECT b FROM pairs WHERE list_contains(picks, a) AND NOT list_contains(picks, b) GROUP BY b "
        "ORDER BY round(sum(d), 9) DESC, b LIMIT 1)) FROM grown WHERE step < 5) "
        "SELECT CAST(i AS INTEGER) AS pick_order, picks[20 + i] AS id FROM (SELECT picks, unnest(range(1, 6)) AS i FROM grown WHERE step = 5)",
        "sample_expand_framed": f"WITH RECURSIVE {POINT_PAIRS}, {CHOSEN}, frame AS (SELECT vec_id AS id FROM embeddings WHERE label < 5), "
        "grown AS (SELECT 0 AS step, (SELECT list(id) FROM chosen) AS picks UNION ALL "
        "SELECT step + 1, list_append(picks, (SELECT b FROM pairs WHERE list_contains(picks, a) AND NOT list_contains(picks, b) AND b IN (SELECT id FROM frame) GROUP BY b "
        "ORDER BY round(sum(d), 9) DESC, b LIMIT 1)) FROM grown WHERE step < 5) "
        "SELECT CAST(i AS INTEGER) AS pick_order, picks[20 + i] AS id FROM (SELECT picks, unnest(range(1, 6)) AS i FROM grown WHERE step = 5)",
        "expand_dataset": f"WITH RECURSIVE {POINT_PAIRS}, {CHOSEN}, grown AS (SELECT 0 AS step, (SELECT list(id) FROM chosen) AS picks UNION ALL "
        "SELECT step + 1, list_append(picks, (SELECT b FROM pairs WHERE list_contains(picks, a) AND NOT list_contains(picks, b) GROUP BY b "
        "ORDER BY round(sum(d), 9) DESC, b LIMIT 1)) FROM grown WHERE step < 5), "
        "stage AS (SELECT CASE step WHEN 0 THEN 'before' ELSE 'after' END AS what, unnest(picks) AS id FROM grown WHERE step IN (0, 5)), "
        "duo AS (SELECT l.what, avg(d) / (SELECT max(d) FROM pairs) AS value FROM stage l JOIN stage r ON l.what = r.what AND l.id < r.id JOIN pairs ON a = l.id AND b = r.id GROUP BY 1) "
        "SELECT 'pick' AS what, i AS id, CAST(picks[20 + i] AS DOUBLE) AS value FROM (SELECT picks, unnest(range(1, 6)) AS i FROM grown WHERE step = 5) "
        "UNION ALL SELECT what, 0, round(value, 6) FROM duo",
        "sample_from_relation_maxsum": _sample_greedy(SITE_PAIRS, 6, "sum"),
        "sample_from_relation_maxmin": _sample_greedy(SITE_PAIRS, 6, "min"),
        "within_sample_distance": f"WITH {POINT_PAIRS}, lb AS (SELECT vec_id AS id, label FROM embeddings) SELECT l.label AS \"group\", round(sum(d), 6) AS sum_d, count(*) AS n_pairs "
        "FROM pairs JOIN lb l ON l.id = a JOIN lb r ON r.id = b AND l.label = r.label WHERE a < b GROUP BY 1",
        "summed_distance_to_set": f"WITH {POINT_PAIRS}, {CHOSEN} SELECT b AS id, round(sum(d), 6) AS score FROM pairs WHERE a IN (SELECT id FROM chosen) GROUP BY 1",
        "min_distance_to_set": f"WITH {POINT_PAIRS}, {CHOSEN} SELECT b AS id, round(min(d), 6) AS score FROM pairs WHERE a IN (SELECT id FROM chosen) AND b NOT IN (SELECT id FROM chosen) GROUP BY 1",
        "metric_mpd": _by_family("SELECT grp AS \"group\", round(mpd, 6) AS mpd FROM m_mpd"),
        "metric_fvo": _fvo_modes(),
        "metric_entropy_with_missing": _by_family("SELECT grp AS \"group\", round(entropy_with_missing, 6) AS entropy_with_missing FROM m_val"),
        "metric_entropy_without_missing": _by_family("SELECT grp AS \"group\", round(entropy_without_missing, 6) AS entropy_without_missing FROM m_val"),
        "metric_fvi": _by_family("SELECT grp AS \"group\", round(fvi, 6) AS fvi FROM m_val"),
        "evaluate_samples": f"WITH {LONG}, pairs AS (SELECT {_nan_euclid()} AS d FROM bin a, bin b), {_draws(DRAWS)}, {_metrics(_random('bin'), KEYS, 'SELECT d FROM pairs')} {_scored(KEYS)}",
        "sweep_results": f"{_sweep_ctes()} {_scored(KEYS)}",
        "sweep_unframed": f"{_sweep_ctes('id IN (SELECT id FROM taxed)')} {_scored(KEYS)}",
        "sweep_summary": f"{_sweep_ctes()} SELECT method, k, count(*) AS runs, {summary} FROM m_val JOIN m_mpd USING ({KEYS}) JOIN m_fvo USING ({KEYS}) GROUP BY 1, 2",
        "results_by_label": f"{_sweep_ctes()} SELECT {labels} AS \"Method\", run, k, CAST(id AS VARCHAR) AS id FROM smp WHERE k = 4 AND (method IN ('maxsum', 'maxmin') OR run = 0)",
        "relation_mpd": f"WITH {SITE_PAIRS}, draws AS (SELECT * FROM (VALUES (0, 5, 5), (1, 5, 6)) v(run, k, seed)), smp AS ({_random('site')}) "
        "SELECT l.run, round(avg(d), 6) AS mpd FROM smp l JOIN smp r ON l.run = r.run AND l.id < r.id JOIN pairs ON a = l.id AND b = r.id GROUP BY 1",
        "group_overlap_family": _part_overlap(FAMILY, "family", "family"),
        "group_overlap_genus": _part_overlap(GENUS, "genus", "genus"),
        "group_overlap_documents": f"WITH {OVERLAPS} SELECT method, \"group\", round(avg_overlap, 6) AS avg_overlap, n_members FROM ovl",
        "overlap_histogram": f"WITH {OVERLAPS} SELECT method, CAST(floor(round(avg_overlap, 9) / 0.02 + 1e-9) AS INTEGER) AS bin, count(*) AS n FROM ovl WHERE avg_overlap > 0 GROUP BY 1, 2",
        "top_groups": f"WITH {OVERLAPS} SELECT method, \"group\", round(avg_overlap, 6) AS avg_overlap, n_members FROM ovl WHERE method = 'genus' AND avg_overlap > 0 ORDER BY \"group\" LIMIT 10",
        "group_sizes": f"WITH {GENUS} SELECT grp AS \"group\", count(*) AS n_members FROM genus GROUP BY 1",
        "group_members": f"WITH {FAMILY} SELECT grp AS \"group\", id FROM family WHERE grp IS NOT NULL",
        "ungrouped_items": f"WITH {FAMILY} SELECT id FROM family WHERE grp IS NULL",
        "nearest_with_ties": f"WITH {PAIRS}, nn AS (SELECT a, round(d, 9) AS d, rank() OVER (PARTITION BY a ORDER BY round(d, 9)) AS rk FROM pairs WHERE round(d, 9) > 0), "
        f"prof AS (SELECT id, min(id) OVER (PARTITION BY {_SAME_VECTOR}) AS profile FROM bin) "
        "SELECT a AS id, any_value(profile) AS profile, round(any_value(d), 6) AS nearest_d, count(*) AS n_nearest FROM nn JOIN prof ON prof.id = a WHERE rk = 1 GROUP BY 1",
        "neighbour_group_purity": f"WITH {PAIRS}, {FAMILY}, nn AS (SELECT a, b, rank() OVER (PARTITION BY a ORDER BY round(d, 9)) AS rk FROM pairs WHERE round(d, 9) > 0) "
        "SELECT count(*) FILTER (WHERE l.grp IS NOT DISTINCT FROM r.grp) AS in_group, count(*) FILTER (WHERE l.grp IS DISTINCT FROM r.grp) AS out_group, count(*) AS total "
        "FROM nn JOIN family l ON l.id = a JOIN family r ON r.id = b WHERE rk = 1",
        "frame_intersect": f"WITH {frames} SELECT id FROM taxed INTERSECT SELECT id FROM f1 INTERSECT SELECT id FROM f2",
        "frame_intersect_count": f"WITH {frames} SELECT count(*) AS n FROM (SELECT id FROM taxed INTERSECT SELECT id FROM f1 INTERSECT SELECT id FROM f2)",
        "frame_difference": f"WITH {frames} SELECT id FROM f1 EXCEPT SELECT id FROM taxed",
        "frame_union": f"WITH {frames} SELECT id FROM taxed UNION SELECT id FROM f2",
        "frame_union_tagged": f"WITH {frames} SELECT 'taxed' AS frame, id, CAST(NULL AS INTEGER) AS extra FROM taxed UNION ALL SELECT 'family', id, NULL FROM f1 UNION ALL SELECT 'genus', id, 1 FROM f2",
        "dataset_coverage": f"WITH {TAXED} SELECT count(DISTINCT l_partkey) AS n_dataset, count(DISTINCT l_partkey) FILTER (WHERE l_partkey IN (SELECT id FROM taxed)) AS n_covered FROM lineitem",
        "duplicate_ids": "SELECT l_orderkey AS id, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) > 1",
        "map_codes": f"WITH {codes}, {first}, {rows} SELECT item, item.code, first_id, last_id FROM item LEFT JOIN first USING (code)",
        "unmapped_codes": f"WITH {codes}, {rows} SELECT code, count(*) AS n FROM item WHERE code NOT IN (SELECT code FROM code) GROUP BY 1",
        "code_names": "SELECT c_custkey, CAST(c_nationkey AS VARCHAR) AS id, n_name AS name FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey",
        "geo_distances": f"WITH {SITE_PAIRS} SELECT a, b, round(d, 6) AS d, x.w AS n_a, y.w AS n_b FROM pairs JOIN site x ON x.id = a JOIN site y ON y.id = b WHERE a < b",
        "geo_symmetrized": f"WITH {SITE_PAIRS} {both_ways}",
        "geo_pair_kilometres": f"WITH {PLACES} SELECT x.id AS a, y.id AS b, round({_km('x', 'y')}, 6) AS d FROM place x JOIN place y ON y.id = x.id + 1",
        "unit_frequency": f"WITH {VERSES} SELECT verse_id, count(*) AS n_editions FROM (SELECT DISTINCT lang, edition, verse_id FROM verse) GROUP BY 1",
        "largest_edition": f"WITH {VERSES}, {edition} SELECT * FROM best",
        "most_common_units": f"WITH {VERSES}, {edition} SELECT verse_id, count(*) AS n_editions FROM (SELECT DISTINCT lang, edition, verse_id FROM verse JOIN best USING (lang, edition)) "
        "GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 4",
        "fully_covering": f"WITH {VERSES}, {COMMON}, {covering} SELECT lang FROM cover",
        "selected_units": f"WITH {VERSES}, {COMMON}, {covering} SELECT lang, verse_id, max_by(text, line) AS text FROM verse WHERE verse_id IN (SELECT verse_id FROM common) "
        "AND lang IN (SELECT lang FROM cover) GROUP BY 1, 2",
        "parallel_text": f"WITH {VERSES}, {edition}, pick AS MATERIALIZED (SELECT verse.* FROM verse JOIN best USING (lang, edition)), "
        "many AS (SELECT verse_id, count(*) AS n FROM (SELECT DISTINCT lang, edition, verse_id FROM pick) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 6), "
        "covers AS (SELECT lang FROM pick WHERE verse_id IN (SELECT verse_id FROM many) GROUP BY 1 HAVING count(DISTINCT verse_id) = 6), "
        "test AS (SELECT verse_id FROM (SELECT verse_id, row_number() OVER (ORDER BY md5(concat_ws('|', 1, verse_id)), verse_id) AS rn FROM many) WHERE rn <= 3) "
        "SELECT lang, verse_id, max_by(text, line) AS text FROM pick WHERE verse_id IN (SELECT verse_id FROM test) AND lang IN (SELECT lang FROM covers) GROUP BY 1, 2",
        "avg_tokens": f"WITH ln AS (SELECT lang, unnest(string_split(text, chr(10))) AS line FROM documents), c AS (SELECT lang, {_WORDS.format(text='line')} AS n FROM ln) "
        "SELECT lang, round(avg(n), 6) AS avg_subwords, count(*) AS n_units FROM c WHERE n > 0 GROUP BY 1",
        "avg_tokens_conversations": f"WITH c AS (SELECT role, {_WORDS.format(text='text')} AS n FROM conversations) SELECT role, round(avg(n), 6) AS avg_subwords, count(*) AS n_units FROM c WHERE n > 0 GROUP BY 1",
        "token_summary": _quartiles(),
        "cost_of_members": f"WITH docs AS (SELECT doc_id AS id FROM documents), {_draws(DRAWS)}, smp AS ({_random('docs')}) "
        f"SELECT run, k, smp.id, CAST({_WORDS.format(text='text')} AS INTEGER) AS score FROM smp JOIN documents ON doc_id = smp.id",
    }
