"""String, path, number and vector functions over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tonearm.functions import numeric as N
from tonearm.functions import text as X
from tonearm.plans.registry import query
from tonearm.tables import Tables

WORDS = X.VERSION_WORDS


@query("SELECT id, upper(regexp_replace(isrc, '[^A-Za-z0-9]+', '', 'g')) AS code, CASE WHEN regexp_matches(upper(regexp_replace(isrc, '[^A-Za-z0-9]+', '', 'g')), '^[A-Z]{2}[A-Z0-9]{3}[0-9]{7}$') THEN upper(regexp_replace(isrc, '[^A-Za-z0-9]+', '', 'g')) END AS valid FROM r_parts")
def code_canonical(t: Tables) -> DataFrame:
    return t.parts.select("id", X.isrc_code(F.col("isrc")).alias("code"), X.valid_isrc(F.col("isrc")).alias("valid"))


TITLES = "SELECT id, CASE id % 6 WHEN 0 THEN title || ' (feat. ' || artist || ')' WHEN 1 THEN title || ' - Live ' || album WHEN 2 THEN title || ' [Radio Edit]' WHEN 3 THEN title || ' ft. ' || artist WHEN 4 THEN title || ' Extended Mix' ELSE title END AS title FROM r_parts"


def titles(t: Tables) -> DataFrame:
    """Titles with the credits and versions that the title functions are for."""
    title, artist = F.col("title"), F.col("artist")
    forms = {0: F.concat(title, F.lit(" (feat. "), artist, F.lit(")")), 1: F.concat(title, F.lit(" - Live "), F.col("album")), 2: F.concat(title, F.lit(" [Radio Edit]")), 3: F.concat(title, F.lit(" ft. "), artist), 4: F.concat(title, F.lit(" Extended Mix"))}
    out = F.coalesce(*[F.when(F.col("id") % 6 == k, v) for k, v in forms.items()], title)
    return t.parts.select("id", out.alias("title"), "artist", "album")


IDENTITY = r"coalesce(nullif(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace({x}, '" + X.NOISE_IN_BRACKETS + "', '', 'g'), '" + X.NOISE_TO_END + r"', '', 'g'), '[^\w'']+', ' ', 'g'), '\s+', ' ', 'g')), ''), {x})"
UNVERSIONED = rf"regexp_replace(regexp_replace(t, '{X.VERSION_IN_BRACKETS}', '', 'g'), '{X.VERSION_TO_END}', '', 'g')"


@query(rf"SELECT id, {IDENTITY.format(x='t')} AS identity, k AS title_key, split_part(k, ' ', 1) AS bucket, array_to_string(list_sort(list_distinct(regexp_extract_all(t, '\b(?:{WORDS})\b'))), ',') AS versions FROM (SELECT id, t, {IDENTITY.format(x='u')} AS k FROM (SELECT id, t, {UNVERSIONED} AS u FROM (SELECT id, lower(title) AS t FROM ({TITLES}))))")
def title_key(t: Tables) -> DataFrame:
    low = titles(t).select("id", F.lower("title").alias("t"))
    key = low.withColumn("k", X.title_key(F.col("t")))
    return key.select("id", X.title_identity(F.col("t")).alias("identity"), F.col("k").alias("title_key"), F.split_part("k", F.lit(" "), F.lit(1)).alias("bucket"), F.array_join(X.version_words(F.col("t")), ",").alias("versions"))


@query("SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host, regexp_replace(regexp_replace(url, '^[a-z]+://[^/]+', ''), '[?#].*$', '') AS path, regexp_extract(url, '/([a-z]{2})/([0-9]+)', 1) AS lang, try_cast(nullif(regexp_extract(url, '/([a-z]{2})/([0-9]+)', 2), '') AS BIGINT) AS number, regexp_matches(url, '[.]html([?#]|$)') AS is_html FROM pages")
def path_parts(t: Tables) -> DataFrame:
    url = F.col("url")
    path = F.regexp_replace(F.regexp_replace(url, "^[a-z]+://[^/]+", ""), "[?#].*$", "")
    return t.raw("pages").select("page_id", F.regexp_extract(url, "^[a-z]+://([^/?#]+)", 1).alias("host"), path.alias("path"), F.regexp_extract(url, "/([a-z]{2})/([0-9]+)", 1).alias("lang"), F.expr("try_cast(regexp_extract(url, '/([a-z]{2})/([0-9]+)', 2) AS BIGINT)").alias("number"), url.rlike("[.]html([?#]|$)").alias("is_html"))


FILES = "SELECT id, CASE id % 5 WHEN 0 THEN artist || '/' || album || '/0' || CAST(id % 9 + 1 AS VARCHAR) || ' - ' || title || '.MP3' WHEN 1 THEN '../' || title || '.flac' WHEN 2 THEN '/abs/' || title || '.wav' WHEN 3 THEN artist || '\\' || title || '.txt' ELSE title || '.aif' END AS f FROM r_parts"


def files(t: Tables) -> DataFrame:
    title, artist, album = F.col("title"), F.col("artist"), F.col("album")
    f = F.when(F.col("id") % 5 == 0, F.concat(artist, F.lit("/"), album, F.lit("/0"), (F.col("id") % 9 + 1).cast("string"), F.lit(" - "), title, F.lit(".MP3"))).when(F.col("id") % 5 == 1, F.concat(F.lit("../"), title, F.lit(".flac"))).when(F.col("id") % 5 == 2, F.concat(F.lit("/abs/"), title, F.lit(".wav"))).when(F.col("id") % 5 == 3, F.concat(artist, F.lit("\\"), title, F.lit(".txt"))).otherwise(F.concat(title, F.lit(".aif")))
    return t.parts.select("id", f.alias("f"))


@query(rf"SELECT id, lower(regexp_extract(f, '([.][^./\\]+)$', 1)) AS suffix, regexp_extract(f, '([^/\\]+)$', 1) AS name, starts_with(f, '/') OR starts_with(f, '\') OR list_has_any(regexp_split_to_array(f, '[\\/]+'), ['', '.', '..']) AS unsafe, lower(regexp_extract(f, '([.][^./\\]+)$', 1)) IN ('.mp3', '.flac', '.wav', '.aiff', '.aif') AS supported FROM ({FILES.replace(chr(92) * 2, chr(92))})")
def file_checks(t: Tables) -> DataFrame:
    f = F.col("f")
    return files(t).select("id", X.suffix(f).alias("suffix"), X.basename(f).alias("name"), X.unsafe_path(f).alias("unsafe"), X.suffix(f).isin(*[f".{s}" for s in X.AUDIO_SUFFIXES]).alias("supported"))


def _clean_sql(x: str) -> str:
    for pattern in (X.TRACK_NUMBER, X.LAST_BRACKET, X.LAST_YEAR):
        x = f"regexp_replace({x}, '{pattern}', '')" if "replace(" in x else f"regexp_replace(replace({x}, '_', ' '), '{pattern}', '')"
    return rf"trim(regexp_replace({x}, '\s+', ' ', 'g'))"


NAME = r"regexp_replace(regexp_extract(f, '([^/\\]+)$', 1), '^(.+)[.][^.]+$', '\1')"
PARTS = r"list_filter(regexp_split_to_array(f, '[\\/]+'), lambda p: p <> '')"
JOINED = "array_to_string(list_filter(list_transform({parts}, lambda p: {clean}), lambda p: p <> ''), ' ')"


@query(f"WITH x AS (SELECT id, {_clean_sql('n')} AS s, {PARTS} AS parts FROM (SELECT id, f, {NAME} AS n FROM ({FILES.replace(chr(92) * 2, chr(92))}))), y AS (SELECT id, s, {JOINED.format(parts='parts[:-2]', clean=_clean_sql('p'))} AS folders, {JOINED.format(parts='parts', clean=_clean_sql('p'))} AS everything FROM x) SELECT id, s AS title, folders AS artist, folders AS album, everything AS all FROM y")
def path_context(t: Tables) -> DataFrame:
    """Title, artist and album read out of a file's path."""
    f = F.col("f")
    return files(t).select("id", X.title_in_path(f).alias("title"), X.context_in_path(f, True).alias("artist"), X.context_in_path(f, False).alias("album"), X.whole_path_context(f).alias("all"))


@query()
def query_variants(t: Tables) -> DataFrame:
    """Searches are built for distinct texts, dealt by their number: they are few bytes and much work."""
    rows, texts = titles(t), ["artist", "title", "album"]
    parts = int(t.spark.conf.get("spark.sql.shuffle.partitions"))
    known = rows.select(*[F.col(c).alias(f"_{c}") for c in texts]).distinct().repartition(parts, *[f"_{c}" for c in texts])
    known = known.withColumn("queries", X.query_variants(F.col("_artist"), F.col("_title"), F.col("_album")))
    same = F.col("artist").eqNullSafe(F.col("_artist")) & F.col("title").eqNullSafe(F.col("_title")) & F.col("album").eqNullSafe(F.col("_album"))
    return rows.join(known, same).select("id", "queries")


@query("SELECT title, 'isrc:' || substr(sha256('isrc|' || title || '|' || ids), 1, 24) AS group_key FROM (SELECT title, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) AS ids FROM r_parts GROUP BY title)")
def group_key(t: Tables) -> DataFrame:
    ids = t.parts.groupBy("title").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    return ids.select("title", X.group_key(F.lit("isrc"), F.col("title"), F.array_join(F.transform("ids", lambda x: x.cast("string")), ",")).alias("group_key"))


@query("SELECT id, try_cast(json_extract_string(props, '$.k') AS BIGINT) AS k, coalesce(json_extract_string(props, '$.K'), json_extract_string(props, '$.k')) AS either FROM r_events")
def props_json(t: Tables) -> DataFrame:
    k = F.get_json_object("props", "$.k")
    return t.events.select("id", F.expr("try_cast(get_json_object(props, '$.k') AS BIGINT)").alias("k"), F.coalesce(F.get_json_object("props", "$.K"), k).alias("either"))


@query("SELECT id, trim(regexp_replace(regexp_replace(regexp_replace(title || ' #' || artist || ' / ' || album, '[^A-Za-z0-9._ \\[\\]-]+', '-', 'g'), ' +', ' ', 'g'), '^[ -]+|[ -]+$', '', 'g')) AS name, artist || '/' || title AS joined FROM r_parts".replace("\\\\", "\\"))
def file_names(t: Tables) -> DataFrame:
    raw = F.concat("title", F.lit(" #"), "artist", F.lit(" / "), "album")
    return t.parts.select("id", X.file_name(raw, F.lit("playlist")).alias("name"), F.concat_ws("/", "artist", "title").alias("joined"))


@query("SELECT o_custkey AS key, CAST(count(*) AS BIGINT) AS n, round(list_sort(list(o_totalprice))[CAST(round_even((count(*) - 1) * 0.25, 0) AS INTEGER) + 1], 6) AS q1, round(list_sort(list(o_totalprice))[CAST(round_even((count(*) - 1) * 0.75, 0) AS INTEGER) + 1], 6) AS q3, round(median(o_totalprice), 6) AS mid FROM orders GROUP BY o_custkey")
def nearest_rank(t: Tables) -> DataFrame:
    v = t.raw("orders").groupBy(F.col("o_custkey").alias("key")).agg(F.collect_list("o_totalprice").alias("v"), F.median("o_totalprice").alias("m"))
    return v.select("key", F.size("v").cast("long").alias("n"), F.round(N.nearest_rank(F.col("v"), 0.25), 6).alias("q1"), F.round(N.nearest_rank(F.col("v"), 0.75), 6).alias("q3"), F.round("m", 6).alias("mid"))


def _spread(t: Tables) -> DataFrame:
    return t.features.select("id", F.posexplode("vector").alias("pos", "x")).withColumn("x", F.col("x").cast("double"))


SPREAD = "SELECT id, CAST(generate_subscripts(vector, 1) - 1 AS INTEGER) AS pos, CAST(unnest(vector) AS DOUBLE) AS x FROM r_features"


@query(f"SELECT id, pos, round((x - avg(x) OVER (PARTITION BY pos)) / CASE WHEN stddev_pop(x) OVER (PARTITION BY pos) = 0 THEN 1 ELSE stddev_pop(x) OVER (PARTITION BY pos) END, 6) AS z FROM ({SPREAD})")
def zscore(t: Tables) -> DataFrame:
    """Statistics per position by a partial aggregation, sent back as one small row each."""
    x = _spread(t)
    s = x.groupBy("pos").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"))
    return x.join(F.broadcast(s), "pos").select("id", "pos", F.round((F.col("x") - F.col("m")) / F.when(F.col("s") == 0, 1.0).otherwise(F.col("s")), 6).alias("z"))


@query(f"WITH x AS ({SPREAD}), s AS (SELECT pos, list_sort(list(x)) AS v, median(x) AS m, CAST(count(*) AS BIGINT) AS n FROM x GROUP BY pos), q AS (SELECT pos, m, v[CAST(round_even((n - 1) * 0.75, 0) AS INTEGER) + 1] - v[CAST(round_even((n - 1) * 0.25, 0) AS INTEGER) + 1] AS iqr, (v[n] - v[1]) / 2 AS half FROM s) SELECT id, x.pos, round((x - m) / CASE WHEN iqr > 1e-9 THEN iqr WHEN half > 1e-9 THEN half ELSE 1 END, 6) AS r FROM x JOIN q ON q.pos = x.pos")
def robust_scale(t: Tables) -> DataFrame:
    from tonearm.operators.cluster import robust_limits

    x = _spread(t)
    return x.join(F.broadcast(robust_limits(x)), "pos").select("id", "pos", F.round((F.col("x") - F.col("centre")) / F.col("scale"), 6).alias("r"))


@query(f"WITH x AS ({SPREAD}), c AS (SELECT tag, pos, avg(x) AS m FROM x JOIN r_features USING (id) GROUP BY tag, pos) SELECT x.id, f.tag, round(sqrt(sum((x.x - c.m) * (x.x - c.m))), 6) AS distance FROM x JOIN r_features f ON f.id = x.id JOIN c ON c.tag = f.tag AND c.pos = x.pos GROUP BY x.id, f.tag")
def distance_to_centroid(t: Tables) -> DataFrame:
    from tonearm.operators.cluster import centroids

    c = centroids(t.features, "tag")
    return t.features.join(c, "tag").select("id", "tag", F.round(N.distance(F.col("vector"), F.col("centroid")), 6).alias("distance"))


@query("SELECT id, CAST((CAST(id AS HUGEINT) * 1103515245 + 7 * 12345) % 4294967296 AS BIGINT) AS rank FROM r_tracks")
def seeded_shuffle(t: Tables) -> DataFrame:
    return t.tracks.select("id", N.seeded_rank(F.col("id"), 7).alias("rank"))


@query("SELECT id, CASE WHEN s < 0.4 THEN 'Low Energy' WHEN s < 0.72 THEN 'Medium Energy' ELSE 'High Energy' END AS band, round(s, 6) AS score FROM (SELECT id, (greatest(0.0, least(1.0, (tempo - 85) / 50)) + greatest(0.0, least(1.0, (rms - 0.08) / 0.28)) + greatest(0.0, least(1.0, onset / 2))) / 3 AS s FROM (SELECT event_id AS id, 60 + value AS tempo, value / 100 AS rms, CAST((event_id % 30) AS DOUBLE) / 10 AS onset FROM events))")
def energy_band(t: Tables) -> DataFrame:
    score = N.energy_score(F.col("value") + 60, F.col("value") / 100, (F.col("id") % 30).cast("double") / 10)
    return t.events.select("id", score.alias("s")).select("id", N.energy_band(F.col("s")).alias("band"), F.round("s", 6).alias("score"))


@query("SELECT id, round(CASE WHEN v <= 0 THEN NULL WHEN v < 85 THEN v * pow(2, ceil(log2(85 / v))) WHEN v > 170 THEN v / pow(2, ceil(log2(v / 170))) ELSE v END, 6) AS bpm FROM (SELECT event_id AS id, value * 7 AS v FROM events)")
def octave(t: Tables) -> DataFrame:
    return t.events.select("id", F.round(N.octave_fold(F.col("value") * 7), 6).alias("bpm"))


@query("SELECT user_id AS key, min(v) AS low, max(v) AS high, CASE WHEN max(v) - min(v) <= 2 THEN CAST(CAST(round_even(median(value), 0) AS BIGINT) AS VARCHAR) || ' BPM' ELSE CAST(min(v) AS VARCHAR) || '-' || CAST(max(v) AS VARCHAR) || ' BPM' END AS label FROM (SELECT user_id, value, CAST(round_even(value, 0) AS BIGINT) AS v FROM events WHERE value > 0) GROUP BY user_id")
def bpm_label(t: Tables) -> DataFrame:
    v = t.events.where("value > 0").groupBy("key").agg(F.bround(F.min("value")).cast("long").alias("low"), F.bround(F.max("value")).cast("long").alias("high"), F.bround(F.median("value")).cast("long").alias("mid"))
    label = F.when(F.col("high") - F.col("low") <= 2, F.concat(F.col("mid").cast("string"), F.lit(" BPM"))).otherwise(F.concat(F.col("low").cast("string"), F.lit("-"), F.col("high").cast("string"), F.lit(" BPM")))
    return v.select("key", "low", "high", label.alias("label"))


@query("SELECT id, CASE WHEN d <= 5000 THEN 1.0::DOUBLE WHEN d >= 60000 THEN 0.0::DOUBLE ELSE round(1.0::DOUBLE - d / 60000::DOUBLE, 6) END AS bonus, d > greatest(60000, CAST(floor(e * 0.25) AS BIGINT)) AS severe FROM (SELECT doc_id AS id, n_chars * 100 AS e, abs(n_chars * 100 - 240000) AS d FROM documents)")
def duration_rules(t: Tables) -> DataFrame:
    expected, found = F.col("n_chars") * 100, F.lit(240000)
    return t.raw("documents").select(F.col("doc_id").alias("id"), F.round(N.duration_bonus(expected, found), 6).alias("bonus"), N.severe_mismatch(expected, found).alias("severe"))


@query("SELECT id, trim(regexp_replace(lower(title), '\\s+', ' ', 'g')) AS text, lower(title) AS folded FROM (SELECT id, '  ' || upper(title) || '   ' || artist || ' ' AS title FROM r_parts)".replace("\\\\", "\\"))
def normalised_text(t: Tables) -> DataFrame:
    raw = t.parts.select("id", F.concat(F.lit("  "), F.upper("title"), F.lit("   "), F.col("artist"), F.lit(" ")).alias("x"))
    return raw.select("id", X.match_text(F.col("x")).alias("text"), X.casefolded(F.col("x")).alias("folded"))


@query("SELECT conv_id, CAST(count(*) AS BIGINT) AS turns, string_agg(role, '>' ORDER BY turn) AS roles, CAST(sum(length(text)) AS BIGINT) AS chars FROM conversations GROUP BY conv_id")
def ordered_turns(t: Tables) -> DataFrame:
    c = t.raw("conversations").groupBy("conv_id").agg(F.count("*").alias("turns"), F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("x"), F.sum(F.length("text")).alias("chars"))
    return c.select("conv_id", "turns", F.array_join(F.transform("x", lambda v: v["role"]), ">").alias("roles"), "chars")


@query("SELECT tag, CAST(count(*) AS BIGINT) AS n FROM (SELECT trim(unnest(regexp_split_to_array(p_name || '; ' || p_type || ',' || p_brand, '[;,]'))) AS tag FROM part) WHERE tag <> '' GROUP BY tag")
def tag_frequency(t: Tables) -> DataFrame:
    tags = t.parts.select(F.explode(X.split_tags(F.concat("title", F.lit("; "), "album", F.lit(","), "artist"))).alias("tag"))
    return tags.groupBy("tag").agg(F.count("*").alias("n"))


@query("SELECT label AS tag, row_number() OVER (PARTITION BY label ORDER BY vec_id) % 3 AS child, CAST(count(*) OVER (PARTITION BY label) AS BIGINT) AS siblings, vec_id AS id FROM embeddings")
def tree_rows(t: Tables) -> DataFrame:
    w = W.partitionBy("tag")
    return t.features.select("tag", (F.row_number().over(w.orderBy("id")) % 3).cast("long").alias("child"), F.count("*").over(w).alias("siblings"), "id")


@query("WITH g AS (SELECT id, list_distinct(flatten(list_transform(list_filter(regexp_split_to_array(lower(title), '[^\\p{L}\\p{N}]+'), lambda w: w <> ''), lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3))))) AS g FROM r_parts), q AS (SELECT g AS qg FROM g WHERE id = 7) SELECT id, round(len(list_intersect(g, qg))::DOUBLE / (len(g) + len(qg) - len(list_intersect(g, qg))), 6) AS similarity FROM g, q WHERE len(list_intersect(g, qg))::DOUBLE / (len(g) + len(qg) - len(list_intersect(g, qg))) >= 0.3".replace("\\\\", "\\"))
def trigram_search(t: Tables) -> DataFrame:
    """Titles like that of part 7: one needle, read once, against all titles."""
    from tonearm.functions.similarity import trigram_similarity

    needle = t.parts.where("id = 7").select(F.col("title").alias("needle"))
    return t.parts.join(F.broadcast(needle), F.lit(True)).select("id", trigram_similarity(F.col("title"), F.col("needle")).alias("s")).where("s >= 0.3").select("id", F.round("s", 6).alias("similarity"))
