"""Feature groups over (row, candidate): entities, tags, popularity, dates and durations, vectors, labels."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import char_bucket, duration_bucket, isrc_country, isrc_year, norm_name, quantised
from tessera.functions.vectors import centroid, dot, l2
from tessera.operators.blocks import steady
from tessera.operators.turns import ROW, last_played
from tessera.ship import ship
from tessera.store import dealt

#: Fixed value: the year that ages are reckoned against.
THIS_YEAR = 2026
#: Sums of rows and tokens that are held at once.
CELLS = 2_000_000


# -- entities -----------------------------------------------------------------------------------------


def same_entity(candidates: DataFrame, hist: DataFrame, catalog: DataFrame) -> DataFrame:
    """Plays of the candidate's first artist, first album and first tag, of the track itself, and whether the latest track shares them.

    What a track lacks equals nothing, as null equals nothing.
    """
    own = catalog.select("track_id", *[F.get(c, F.lit(0)).alias(n) for c, n in (("artists", "artist"), ("albums", "album"), ("tags", "tag"))])
    h = hist.join(own, "track_id")
    out = candidates.join(own, "track_id")
    for name in ("artist", "album", "tag"):
        plays = h.filter(F.col(name).isNotNull()).groupBy(*ROW, name).agg(F.count(F.lit(1)).alias(f"same_{name}"))
        out = out.join(plays, [*ROW, name], "left")
    tracks = hist.groupBy(*ROW, "track_id").agg(F.lit(1).alias("same_track"))
    last = last_played(hist).join(own, "track_id").select(*ROW, F.col("artist").alias("last_artist"), F.col("album").alias("last_album"))
    out = out.join(tracks, [*ROW, "track_id"], "left").join(last, ROW, "left")
    flag = lambda n: F.coalesce((F.col(n) == F.col(f"last_{n}")).cast("int"), F.lit(0)).alias(f"is_last_{n}")
    return out.select(*ROW, "track_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("same_artist", "same_album", "same_tag", "same_track")], flag("artist"), flag("album"))


def _firsts(catalog: DataFrame) -> list[Column]:
    return [F.get(c, F.lit(0)).alias(n) for c, n in (("artists", "artist"), ("albums", "album"), ("tags", "tag"))]


def entity_about(catalog: DataFrame) -> DataFrame:
    return catalog.select("track_id", F.struct(*_firsts(catalog)).alias("about"))


def listed_same_entity(lists: DataFrame) -> DataFrame:
    """same_entity of lists whose rows have past, plays with about, and whose entries have about; no candidate meets another row."""
    each = lists.select(*ROW, "past", F.explode("top").alias("x")).filter("x.about IS NOT NULL")
    of = lambda n: F.transform("past", lambda h: h["about"][n])
    plays = {n: each["x.about"][n] for n in ("artist", "album", "tag")}
    count = lambda n, v: F.coalesce(F.size(of(n)) - F.size(F.array_remove(of(n), v)), F.lit(0)).cast("long").alias(f"same_{n}")
    last = F.try_element_at("past", F.lit(-1))["about"]
    flag = lambda n: F.coalesce((plays[n] == last[n]).cast("int"), F.lit(0)).alias(f"is_last_{n}")
    same = F.array_contains(F.col("past.track_id"), F.col("x.track_id")).cast("int").alias("same_track")
    return each.select(*ROW, F.col("x.track_id").alias("track_id"), count("artist", plays["artist"]), count("album", plays["album"]), count("tag", plays["tag"]), same, flag("artist"), flag("album"))


def basics(candidates: DataFrame, catalog: DataFrame, hist: DataFrame, users: DataFrame | None = None) -> DataFrame:
    """Popularity, log duration, release year, turn and length of the history; with users(session_id, age) also the age, 0 if unknown."""
    n = hist.groupBy(*ROW).agg(F.count(F.lit(1)).alias("n_history"))
    own = catalog.select("track_id", "popularity", quantised(F.log1p("duration")).alias("log_duration"), "year")
    out = candidates.join(own, "track_id").join(n, ROW, "left").withColumn("n_history", F.coalesce("n_history", F.lit(0)))
    columns = [*ROW, "track_id", "popularity", "log_duration", "year", "n_history"]
    if users is not None:
        out = out.join(users.select("session_id", "age"), "session_id", "left").withColumn("user_age", F.coalesce(F.col("age"), F.lit(0)))
        columns.append("user_age")
    return out.select(*columns)


def rank_family(candidates: DataFrame, neutral: bool = True) -> DataFrame:
    """Rank, its logarithm and inverse, and a candidate score of 0; all 0 where the set is neutral."""
    r = F.col("rank")
    forms = {"candidate_rank": r.cast("double"), "candidate_log_rank": quantised(F.log1p(r)), "candidate_inv_rank": quantised(1.0 / r), "candidate_score": F.lit(0.0)}
    return candidates.select(*ROW, "track_id", *[(F.lit(0.0) if neutral else v).alias(k) for k, v in forms.items()])


def reserved(df: DataFrame, zeros: list[str], constants: dict[str, str]) -> DataFrame:
    """Columns that a model's layout reserves: zeros and constant categories."""
    return df.withColumns({z: F.lit(0.0) for z in zeros} | {k: F.lit(v) for k, v in constants.items()})


def labels(candidates: DataFrame, golds: DataFrame) -> DataFrame:
    """With label (the candidate is the gold) and the size of its group."""
    size = F.count(F.lit(1)).over(Window.partitionBy(*ROW))
    return candidates.join(golds.select(*ROW, "gold"), ROW).withColumns({"label": (F.col("track_id") == F.col("gold")).cast("int"), "group_size": size}).drop("gold")


def listed_labels(lists: DataFrame, gold: str) -> DataFrame:
    """labels of lists whose rows have their gold: (row, track_id, rank, label, group_size)."""
    each = lists.select(*ROW, gold, F.size("top").cast("long").alias("group_size"), F.explode("top").alias("x"))
    return each.select(*ROW, F.col("x.track_id").alias("track_id"), F.col("x.rank").alias("rank"), (F.col("x.track_id") == F.col(gold)).cast("int").alias("label"), "group_size")


def entity_indexes(catalog: DataFrame) -> DataFrame:
    """(kind, key, track_id): a track under its artists and albums, their normalised names, its title, and its pairs of album and artist names."""
    own = catalog.select("track_id", *[F.transform(c, norm_name).alias(f"{c}_names") for c in ("artists", "albums", "titles")], "artists", "albums")
    pairs = F.flatten(F.transform("albums_names", lambda b: F.transform("artists_names", lambda a: F.concat(b, F.lit("|"), a))))
    kinds = {"artist_id": F.col("artists"), "album_id": F.col("albums"), "artist": F.col("artists_names"), "album": F.col("albums_names"), "title": F.col("titles_names"), "album_artist": pairs}
    entry = lambda kind, keys: F.transform(F.array_distinct(keys), lambda k: F.struct(F.lit(kind).alias("kind"), k.alias("key")))
    return own.select("track_id", F.explode(F.flatten(F.array(*[entry(k, v) for k, v in kinds.items()]))).alias("e")).select("e.kind", "e.key", "track_id")


# -- years, durations, codes --------------------------------------------------------------------------


def year_gap(candidates: DataFrame, hist: DataFrame, catalog: DataFrame) -> DataFrame:
    """Distance of the release year from the history's mean, unknown years counted there as 0; 0 where either is unknown."""
    years = catalog.select("track_id", "year")
    mean = hist.join(years, "track_id").groupBy(*ROW).agg(F.avg("year").alias("mean_year"))
    return candidates.join(years, "track_id").join(mean, ROW, "left").select(*ROW, "track_id", _gap(F.col("year"), F.col("mean_year")))


def _gap(year: Column, mean_year: Column) -> Column:
    return quantised(F.when((mean_year > 0) & (year > 0), F.abs(year - mean_year)).otherwise(0.0)).alias("year_gap")


def mean_of(values: Column) -> Column:
    """The mean of an array of numbers, null of an empty one."""
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x.cast("double")) / F.nullif(F.size(values), F.lit(0))


def listed_year_gap(lists: DataFrame) -> DataFrame:
    """year_gap of lists whose rows have mean_year and whose entries have about.year."""
    each = lists.select(*ROW, "mean_year", F.explode("top").alias("x")).filter("x.about IS NOT NULL")
    return each.select(*ROW, F.col("x.track_id").alias("track_id"), _gap(F.col("x.about.year"), F.col("mean_year")))


def album_durations(catalog: DataFrame) -> DataFrame:
    """Mean positive duration per track's albums; of several albums the one first met latest in the catalog decides."""
    known = F.when(F.col("duration") > 0, F.col("duration"))
    tracks = catalog.select("track_id", "duration", F.explode("albums").alias("album"))
    by = tracks.groupBy("album").agg(F.coalesce(F.avg(known), F.lit(0.0)).alias("album_mean"), F.min("track_id").alias("met"))
    return tracks.select("track_id", "album").join(by, "album").groupBy("track_id").agg(F.max_by("album_mean", F.struct("met", "album")).alias("album_mean"))


def _recordings(catalog: DataFrame) -> DataFrame:
    return catalog.select(
        "track_id", "duration", "year", isrc_year(F.col("isrc")).alias("isrc_year"), isrc_country(F.col("isrc")).alias("isrc_country"), duration_bucket(F.col("duration")).alias("duration_bucket")
    )


def recording_about(catalog: DataFrame) -> DataFrame:
    """(track_id, about): what metadata_features reads of a candidate."""
    own = _recordings(catalog).join(album_durations(catalog), "track_id", "left")
    return own.select("track_id", F.struct(*own.columns[1:]).alias("about"))


def metadata_features(candidates: DataFrame, hist: DataFrame, catalog: DataFrame, age: Column, country: Column) -> DataFrame:
    """Codes of the recording, durations against history and album in minutes, and age against release."""
    played_ms = hist.join(catalog.select("track_id", "duration"), "track_id").filter("duration > 0").groupBy(*ROW).agg(F.avg("duration").alias("played_ms"))
    return _metadata(candidates.join(_recordings(catalog), "track_id").join(album_durations(catalog), "track_id", "left").join(played_ms, ROW, "left"), age, country)


def listed_metadata(lists: DataFrame, age: Column, country: Column) -> DataFrame:
    """metadata_features of lists whose rows have played_ms and whose entries have recording_about."""
    each = lists.select(*ROW, "played_ms", F.explode("top").alias("x")).filter("x.about IS NOT NULL")
    return _metadata(each.select(*ROW, "played_ms", F.col("x.track_id").alias("track_id"), "x.about.*"), age, country)


def _metadata(joined: DataFrame, age: Column, country: Column) -> DataFrame:
    known = F.col("isrc_year") > 0
    return joined.select(
        *ROW, "track_id", "isrc_year", (~known).cast("int").alias("isrc_missing"), F.when(known, char_bucket(F.col("isrc_country"))).otherwise(0).alias("isrc_bucket"),
        ((F.length(country) > 0) & (F.col("isrc_country") == F.upper(country))).cast("int").alias("isrc_same_country"),
        F.when(known & (F.col("year") > 0), F.abs(F.col("year") - F.col("isrc_year"))).otherwise(0).alias("isrc_gap"), "duration_bucket",
        quantised(F.when(F.col("played_ms") > 0, (F.col("duration") - F.col("played_ms")) / 60000.0).otherwise(0.0)).alias("vs_history"),
        quantised(F.when(F.col("album_mean") > 0, (F.col("duration") - F.col("album_mean")) / 60000.0).otherwise(0.0)).alias("vs_album"),
        F.when((age > 0) & (F.col("year") > 0), age - (THIS_YEAR - F.col("year"))).otherwise(0).alias("age_gap"),
    )


#: Columns of the extension that stay 0, as the goal and the date of a session are not read.
NEUTRAL = (
    "specificity_track_high", "specificity_expr_high", "specificity_both_high", "session_month", "session_is_weekend", "days_to_xmas", "days_to_halloween", "christmas_tag_near_xmas",
    "halloween_tag_near_halloween",
)


def metadata_extension(candidates: DataFrame, hist: DataFrame, catalog: DataFrame, age: Column, country: Column) -> DataFrame:
    """All eighteen columns: metadata_features and the nine that stay 0."""
    return reserved(metadata_features(candidates, hist, catalog, age, country), list(NEUTRAL), {})


# -- popularity ---------------------------------------------------------------------------------------


def hierarchy(catalog: DataFrame) -> DataFrame:
    """Popularity of a track against its artists' and albums': eight columns. Of several artists the one first met latest in the catalog decides."""
    out = catalog.select("track_id", "popularity")
    for name in ("artist", "album"):
        tracks = catalog.select("track_id", "popularity", F.explode(f"{name}s").alias("entity"))
        by = tracks.groupBy("entity").agg(F.avg("popularity").alias("mean"), F.max("popularity").alias("most"), F.count(F.lit(1)).alias("n"), F.min("track_id").alias("met"))
        own = tracks.select("track_id", "entity").join(by, "entity").groupBy("track_id").agg(F.max_by(F.struct("mean", "most", "n"), F.struct("met", "entity")).alias(name))
        out = out.join(own, "track_id", "left")
    c, zero = F.col, F.lit(0.0)
    ratio = lambda m: F.coalesce(c("popularity") / F.when(c(m) > 0, c(m)), zero)
    return out.select(
        "track_id", quantised(F.log1p("popularity")).alias("log_popularity"), quantised(F.coalesce("artist.mean", zero)).alias("artist_mean"), F.coalesce("artist.most", zero).alias("artist_max"),
        quantised(F.log1p(F.coalesce("artist.n", F.lit(0)))).alias("artist_log_n"), quantised(F.coalesce("album.mean", zero)).alias("album_mean"), quantised(F.log1p(F.coalesce("album.n", F.lit(0)))).alias("album_log_n"),
        quantised(ratio("artist.mean")).alias("over_artist"), quantised(ratio("album.mean")).alias("over_album"),
    )


# -- tags ---------------------------------------------------------------------------------------------


def tag_tokens(catalog: DataFrame, stop: list[str] | None = None, most: int = 4096, per_track: int = 64) -> tuple[DataFrame, DataFrame]:
    """(track_id, token) over the most frequent tokens of two characters or more, at most so many per track; and (token, df)."""
    tokens = F.array_distinct(F.flatten(F.transform("tags", lambda t: F.split(F.lower(t), r"[^\p{L}\p{N}]+"))))
    own = catalog.select("track_id", F.explode(tokens).alias("token")).filter(F.length("token") >= 2)
    if stop:
        own = own.filter(~F.col("token").isin(stop))
    vocabulary = own.groupBy("token").agg(F.count(F.lit(1)).alias("df")).orderBy(F.col("df").desc(), "token").limit(most)
    place = F.row_number().over(Window.partitionBy("track_id").orderBy(F.col("df").desc(), "token"))
    kept = own.join(F.broadcast(vocabulary), "token").withColumn("place", place).filter(F.col("place") <= per_track)
    return kept.select("track_id", "token"), vocabulary


def ppmi(tokens: DataFrame, vocabulary: DataFrame, n_tracks: int, neighbours: int = 20) -> DataFrame:
    """(token, other, value): ln(pairs * N / (df * df)) over 0, the strongest neighbours of each token; ties by the more frequent neighbour, then by name."""
    own = tokens.groupBy("track_id").agg(F.collect_list("token").alias("own"))  # no join, that Spark could take for small and send
    pairs = own.select("own", F.explode("own").alias("token")).select("token", F.explode("own").alias("other")).filter("token <> other").groupBy("token", "other").agg(F.count(F.lit(1)).alias("n"))
    joined = pairs.join(vocabulary, "token").join(vocabulary.select(F.col("token").alias("other"), F.col("df").alias("other_df")), "other")
    value = F.log(F.col("n") * float(n_tracks) / (F.col("df") * F.col("other_df")))
    rank = F.row_number().over(Window.partitionBy("token").orderBy(steady(F.col("value")).desc(), F.col("other_df").desc(), "other"))
    return joined.withColumn("value", value).filter(steady(F.col("value")) > 0).withColumn("place", rank).filter(F.col("place") <= neighbours).select("token", "other", "value", "place")


def tag_chain(candidates: DataFrame, hist: DataFrame, tokens: DataFrame, vocabulary: DataFrame, neighbours: DataFrame, n_tracks: int) -> DataFrame:
    """Overlap, Jaccard and TF-IDF cosine of a candidate's tags with the history's, and how its tags neighbour them.

    Sums over the history's tokens are made once per row and token, and joined with the candidates' tokens.
    """
    idf = vocabulary.select("token", (F.log((1.0 + n_tracks) / (1.0 + F.col("df"))) + 1.0).alias("idf"))
    weights = tokens.join(F.broadcast(idf), "token")
    unit = weights.join(weights.groupBy("track_id").agg(F.sqrt(F.sum(F.col("idf") * F.col("idf"))).alias("norm"), F.count(F.lit(1)).alias("n_tokens")), "track_id")
    unit = unit.select("track_id", "token", (F.col("idf") / F.col("norm")).alias("w"), "n_tokens")
    seen = hist.join(unit.select("track_id", "token", "w"), "track_id").groupBy(*ROW, "token").agg(F.sum("w").alias("h"))
    by_row = seen.groupBy(*ROW).agg(F.count(F.lit(1)).alias("n_seen"), F.sqrt(F.sum(F.col("h") * F.col("h"))).alias("h_norm"))
    near = seen.select(*ROW, "token").join(neighbours, "token").groupBy(*ROW, F.col("other").alias("token")).agg(F.sum("value").alias("ppmi"))
    own = candidates.select(*ROW, "track_id").join(unit, "track_id").join(seen, [*ROW, "token"], "left").join(near, [*ROW, "token"], "left")
    sums = own.groupBy(*ROW, "track_id").agg(
        F.count("h").alias("overlap"), F.first("n_tokens").alias("n_tokens"), F.sum(F.col("w") * F.col("h")).alias("cos"), F.count("ppmi").alias("neighbours"),
        F.coalesce(F.sum("ppmi"), F.lit(0.0)).alias("ppmi_sum"), F.coalesce(F.max("ppmi"), F.lit(0.0)).alias("ppmi_max"),
    )
    joined = sums.join(by_row, ROW, "left")
    union = F.col("n_tokens") + F.coalesce("n_seen", F.lit(0)) - F.col("overlap")
    return joined.select(
        *ROW, "track_id", "overlap", quantised(F.col("overlap") / union).alias("jaccard"), quantised(F.coalesce(F.col("cos") / F.col("h_norm"), F.lit(0.0))).alias("cosine"),
        "neighbours", quantised(F.col("ppmi_sum")).alias("ppmi_sum"), quantised(F.col("ppmi_max")).alias("ppmi_max"),
    )


def listed_tag_chain(lists: DataFrame, codes: DataFrame, vocabulary: DataFrame, neighbours: DataFrame, n_tracks: int) -> DataFrame:
    """tag_chain of lists whose rows have seen, an array of codes per play, and whose entries have about, theirs.

    What goes to the tasks is as much as the vocabulary, which is bounded, and no candidate meets another row.
    """
    spark = lists.sparkSession
    ship(spark)
    n = {r["token"]: (r["code"], r["df"]) for r in codes.join(vocabulary, "token").collect()}
    idf = np.zeros(len(n) + 1)
    for code, df in n.values():
        idf[code] = np.log((1.0 + n_tracks) / (1.0 + df)) + 1.0
    near = sorted((n[r["token"]][0], n[r["other"]][0], r["value"]) for r in neighbours.select("token", "other", "value").collect())
    sent = spark.sparkContext.broadcast((idf, np.array([x[0] for x in near], np.int64), np.array([x[1] for x in near], np.int64), np.array([x[2] for x in near], float)))

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = max(1, CELLS // len(sent.value[0]))
            for at in range(0, batch.num_rows, step):
                yield _chained(batch.slice(at, step), *sent.value)

    own = lists.select(*ROW, "seen", F.transform(F.filter("top", lambda x: x["about"].isNotNull()), lambda x: F.struct(x["track_id"], x["about"])).alias("asked"))
    schema = "session_id long, turn int, track_id long, overlap long, n_tokens long, n_seen long, cos double, h_norm double, neighbours long, ppmi_sum double, ppmi_max double"
    sums = own.mapInArrow(solve, schema)
    union = F.col("n_tokens") + F.col("n_seen") - F.col("overlap")
    cosine = F.when(F.col("overlap") > 0, F.col("cos") / F.col("h_norm")).otherwise(0.0)
    return sums.select(
        *ROW, "track_id", "overlap", quantised(F.col("overlap") / union).alias("jaccard"), quantised(cosine).alias("cosine"), "neighbours", quantised(F.col("ppmi_sum")).alias("ppmi_sum"),
        quantised(F.col("ppmi_max")).alias("ppmi_max"),
    )


def _flat(lists: pa.ListArray) -> tuple[np.ndarray, pa.Array]:
    """Sizes and entries of lists, also of a slice of them."""
    return np.diff(lists.offsets.to_numpy()).astype(np.int64), lists.flatten()


def _chained(batch: pa.RecordBatch, idf: np.ndarray, begins: np.ndarray, others: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
    rows, width = batch.num_rows, len(idf)

    def weighed(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(list, code, weight of unit length)"""
        size, flat = _flat(lists)
        code, owner = flat.to_numpy(zero_copy_only=False).astype(np.int64), np.repeat(np.arange(len(size)), size)
        norm = np.sqrt(np.bincount(owner, idf[code] ** 2, len(size)))
        return owner, code, idf[code] / norm[owner]

    plays, seen = _flat(batch.column(2))
    play, code, weight = weighed(seen)
    row = np.repeat(np.arange(rows), plays)[play]
    h = np.bincount(row * width + code, weight, rows * width).reshape(rows, width)
    at, token = np.nonzero(h)
    first, size = np.searchsorted(begins, token), np.searchsorted(begins, token, "right")
    size = size - first
    entry = np.repeat(first - (np.cumsum(size) - size), size) + np.arange(size.sum())
    near = np.bincount(np.repeat(at, size) * width + others[entry], values[entry], rows * width).reshape(rows, width)

    asked, flat = _flat(batch.column(3))
    owner = np.repeat(np.arange(rows), asked)
    one, code, weight = weighed(flat.field(1))
    mine, close = h[owner[one], code], near[owner[one], code]
    n = len(owner)
    most = np.zeros(n)
    np.maximum.at(most, one, close)
    total = lambda w: np.bincount(one, w, n)
    columns = {
        "overlap": total(mine > 0).astype(np.int64), "n_tokens": np.bincount(one, minlength=n), "n_seen": (h > 0).sum(axis=1)[owner], "cos": total(weight * mine), "h_norm": np.sqrt((h * h).sum(axis=1))[owner],
        "neighbours": total(close > 0).astype(np.int64), "ppmi_sum": total(close), "ppmi_max": most,
    }
    keys = [batch.column(i).take(pa.array(owner)) for i in (0, 1)]
    return pa.RecordBatch.from_arrays([*keys, flat.field(0), *[pa.array(c) for c in columns.values()]], names=[*ROW, "track_id", *columns])


def tag_overlap_history(candidates: DataFrame, hist: DataFrame, tokens: DataFrame) -> DataFrame:
    """Sum over a candidate's tags of how often the history played each."""
    seen = hist.join(tokens, "track_id").groupBy(*ROW, "token").agg(F.count(F.lit(1)).alias("n"))
    own = candidates.select(*ROW, "track_id").join(tokens, "track_id").join(seen, [*ROW, "token"], "left")
    return own.groupBy(*ROW, "track_id").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("tag_overlap"))


def tag_overlap_text(candidates: DataFrame, texts: DataFrame, tokens: DataFrame, key: list[str], text: str) -> DataFrame:
    """Number of a candidate's tags among the tokens of its row's text."""
    from tessera.functions.text import token_set

    asked = texts.select(*key, token_set(F.col(text)).alias("asked"))
    own = tokens.groupBy("track_id").agg(F.collect_list("token").alias("own"))  # both sides whole, so that a candidate is one row throughout
    hits = F.coalesce(F.size(F.array_intersect("own", "asked")), F.lit(0)).cast("long")
    return dealt(candidates.select(*key, "track_id").join(asked, key, "left"), "track_id").join(own, "track_id").select(*key, "track_id", hits.alias("text_overlap"))


def tag_overlap_profile(candidates: DataFrame, profiles: DataFrame, tokens: DataFrame, fields: list[str]) -> DataFrame:
    """Number of a candidate's tags among the tokens of each field of its session's profile; 0 without one."""
    from tessera.functions.text import token_set

    def entry(field: str) -> Column:
        return F.transform(token_set(F.coalesce(F.col(field), F.lit(""))), lambda t: F.struct(F.lit(field).alias("field"), t.alias("token")))

    entries = F.explode(F.flatten(F.array(*[entry(f) for f in fields])))
    asked = profiles.select("session_id", entries.alias("e")).select("session_id", "e.field", "e.token")
    own = candidates.select(*ROW, "track_id").join(tokens, "track_id").join(asked, ["session_id", "token"], "left")
    return own.groupBy(*ROW, "track_id").agg(*[F.count(F.when(F.col("field") == f, 1)).alias(f"{f}_overlap") for f in fields])


def token_codes(vocabulary: DataFrame) -> DataFrame:
    """(token, code): a vocabulary, which is bounded, as small numbers."""
    return vocabulary.select("token", F.row_number().over(Window.orderBy("token")).alias("code"))


def coded(tokens: DataFrame, codes: DataFrame) -> DataFrame:
    """(track_id, token) -> (track_id, about): the codes of a track's tokens as one array."""
    return tokens.join(F.broadcast(codes), "token").groupBy("track_id").agg(F.sort_array(F.collect_list("code")).alias("about"))


def listed_overlap_history(lists: DataFrame) -> DataFrame:
    """tag_overlap_history of lists whose rows have seen, the codes of all plays with repeats, and whose entries have about, their codes."""
    each = lists.select(*ROW, "seen", F.explode("top").alias("x")).filter("x.about IS NOT NULL")
    hits = F.size(F.filter("seen", lambda c: F.array_contains(F.col("x.about"), c))).cast("long")
    return each.select(*ROW, F.col("x.track_id").alias("track_id"), hits.alias("tag_overlap"))


def listed_overlap_profile(lists: DataFrame, fields: list[str]) -> DataFrame:
    """tag_overlap_profile of lists whose rows have an array of tokens per field and whose entries have about, an array of theirs."""
    each = lists.select(*ROW, *fields, F.explode("top").alias("x")).filter("x.about IS NOT NULL")
    hits = lambda f: F.coalesce(F.size(F.array_intersect(F.col("x.about"), F.col(f))), F.lit(0)).cast("long")
    return each.select(*ROW, F.col("x.track_id").alias("track_id"), *[hits(f).alias(f"{f}_overlap") for f in fields])


# -- text ---------------------------------------------------------------------------------------------


def text_cosines(candidates: DataFrame, texts: dict[str, DataFrame], tracks: DataFrame) -> DataFrame:
    """For each named kind of text the cosine of its vector with the candidate's, 0 where they share no term.

    texts: name -> unit vectors (row, term, w); tracks: unit vectors (track_id, term, w).
    """
    pairs = candidates.select(*ROW, "track_id").join(tracks.select("track_id", "term", F.col("w").alias("v")), "track_id")
    out = candidates.select(*ROW, "track_id")
    for name, vectors in texts.items():
        value = pairs.join(vectors.select(*ROW, "term", "w"), [*ROW, "term"]).groupBy(*ROW, "track_id").agg(F.sum(F.col("w") * F.col("v")).alias(name))
        out = out.join(value, [*ROW, "track_id"], "left")
    return out.select(*ROW, "track_id", *[quantised(F.coalesce(n, F.lit(0.0))).alias(n) for n in texts])


# -- vectors ------------------------------------------------------------------------------------------


def centroid_cosine(candidates: DataFrame, hist: DataFrame, vectors: DataFrame, keys: list[str], item: str, vector: str) -> DataFrame:
    """Dot product of a candidate with the unit centroid of its row's history; 0 without one."""
    mean = centroid(hist.join(vectors, item), keys, vector)
    own = candidates.select(*keys, item).join(vectors, item).join(mean, keys, "left")
    value = F.when(F.col("centroid").isNull(), F.lit(0.0)).otherwise(dot(F.col(vector), l2(F.col("centroid"))))
    return own.select(*keys, item, quantised(value).alias("cosine"))


def query_cosines(candidates: DataFrame, queries: DataFrame, hist: DataFrame, vectors: DataFrame, keys: list[str], item: str, vector: str) -> DataFrame:
    """Dot products of a row's query vector with the candidate and with the unit centroid of its history, and whether the candidate has a vector.

    queries(keys, query) has unit vectors; 0 where a vector is missing.
    """
    mean = centroid(hist.join(vectors, item), keys, vector)
    own = candidates.select(*keys, item).join(vectors, item, "left").join(queries.select(*keys, "query"), keys, "left").join(mean, keys, "left")
    product = lambda a, b: quantised(F.when(a.isNull() | b.isNull(), F.lit(0.0)).otherwise(dot(a, b)))
    return own.select(
        *keys, item, product(F.col("query"), F.col(vector)).alias("query_candidate"), product(F.col("query"), l2(F.col("centroid"))).alias("query_history"), F.col(vector).isNotNull().cast("int").alias("has_vector")
    )


def joint_vector(modalities: list[Column], popularity: Column) -> Column:
    """Unit vectors of all modalities one after another, then log popularity."""
    return F.concat(*[l2(m) for m in modalities], F.array(F.log1p(popularity)))
