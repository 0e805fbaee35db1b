"""From ids and free-text questions to players and their vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitchframe.functions.arrays import fit_width, l2_normalise
from pitchframe.functions.matching import matching_ratio
from pitchframe.functions.text import asked_name, asked_team, casefold, int_key, strip_zeros
from pitchframe.plans.session import staged

CUTOFF = 0.75
# First search for similar names: cutoff and piece length.
CLOSE, CLOSE_PIECE = 0.95, 3
# Whole roster, as a scope beside the teams.
EVERYONE = "*"


def resolve_ids(requests: DataFrame, vectors: DataFrame, id_col: str = "id") -> DataFrame:
    """(asked, found): the id itself, else its whole number, else without leading zeros; unknown ids are missing.

    Runs on distinct ids, so an id that many rows ask for is looked up once.
    """
    asked = requests.select(F.col(id_col).alias("asked")).distinct()
    forms = F.array(F.col("asked"), int_key("asked"), strip_zeros("asked"))
    known = vectors.select(F.col("id").alias("key")).distinct()
    return (
        asked.select("asked", F.posexplode(forms).alias("form", "key"))
        .join(known, "key")
        .groupBy("asked")
        .agg(F.min_by("key", "form").alias("found"))
    )


def lookup_vector(requests: DataFrame, vectors: DataFrame, id_col: str = "id") -> DataFrame:
    """Request rows with `vector_id` and `vec` of the vector their id stands for."""
    found = resolve_ids(requests, vectors, id_col).join(
        vectors.select(F.col("id").alias("found"), "vec"), "found"
    )
    return requests.join(found.withColumnRenamed("asked", id_col), id_col).withColumnRenamed("found", "vector_id")


def missing_vectors(requests: DataFrame, vectors: DataFrame, id_col: str = "id") -> DataFrame:
    """Request rows whose id stands for no vector."""
    found = resolve_ids(requests, vectors, id_col).select(F.col("asked").alias(id_col))
    return requests.join(found, id_col, "left_anti")


def supervision_with_vectors(supervision: DataFrame, vectors: DataFrame) -> DataFrame:
    """Supervision rows with their unit vector of the fixed width."""
    fitted = vectors.select("id", fit_width("vec").alias("vec"))
    return lookup_vector(supervision, fitted.select("id", l2_normalise("vec").alias("vec")))


def name_pool(roster: DataFrame) -> DataFrame:
    """Names and aliases with the id they belong to, duplicates kept: (id, label, kind), names being kind 0."""
    names = roster.select("id", F.col("name").alias("label"), F.lit(0).alias("kind"))
    aliases = roster.select("id", F.explode("alts").alias("label"), F.lit(1).alias("kind"))
    return names.unionByName(aliases)


def _pieces(text: Column, lengths: Column) -> Column:
    """All pieces of `text` that have one of the lengths."""
    fitting = F.filter(lengths, lambda m: (m >= 1) & (m <= F.length(text)))
    per_length = F.transform(
        fitting, lambda m: F.transform(F.sequence(F.lit(1), F.length(text) - m + 1), lambda i: text.substr(i, m))
    )
    return F.flatten(per_length)


def _lengths(needles: DataFrame, col: str) -> Column:
    return needles.agg(F.collect_set(F.length(col))).scalar()


def _asked(questions: DataFrame) -> DataFrame:
    """Add the asked `team` (empty text if none) and `name`."""
    return questions.withColumns(
        {"team": F.coalesce(asked_team("question"), F.lit("")), "name": asked_name("question")}
    )


def _asks(questions: DataFrame) -> DataFrame:
    """Distinct (team, name) the questions ask for."""
    return (
        _asked(questions)
        .select("team", "name")
        .filter(F.col("name") != "")
        .distinct()
        .withColumns({"team_lc": casefold("team"), "name_lc": casefold("name")})
    )


def _scoped_asks(asks: DataFrame, roster: DataFrame) -> DataFrame:
    """Each ask once for every team it may mean: teams that contain the asked one, else the whole roster.

    Containment is an equality join: a text is contained in a team if it equals one of the team's pieces.
    """
    teams = roster.select(F.col("team_lc").alias("scope")).distinct()
    wanted = asks.filter(F.col("team_lc") != "").select("team_lc").distinct()
    pieces = (
        teams.withColumn("_l", _lengths(wanted, "team_lc"))
        .select("scope", F.explode(F.array_distinct(_pieces(F.col("scope"), F.col("_l")))).alias("team_lc"))
        .join(wanted, "team_lc")
    )
    scope = F.when(F.col("scope").isNull(), EVERYONE).otherwise(F.concat(F.lit("t:"), F.col("scope")))
    return asks.join(pieces, "team_lc", "left").withColumn("scope", scope)


def _scopes(team_lc: str = "team_lc") -> Column:
    return F.explode(F.array(F.lit(EVERYONE), F.concat(F.lit("t:"), F.col(team_lc))))


def _first_id() -> Column:
    """Lowest id in (length, text) order."""
    return F.min(F.struct(F.length("id"), F.col("id")))["id"]


def _exact(asks: DataFrame, roster: DataFrame) -> DataFrame:
    labels = roster.select("id", _scopes().alias("scope"), F.array_union(F.array("name_lc"), F.col("alts_lc")).alias("l"))
    index = labels.select("id", "scope", F.explode("l").alias("name_lc"))
    hits = index.join(asks.select("scope", "name_lc").distinct(), ["scope", "name_lc"])
    hits = hits.groupBy("scope", "name_lc").agg(_first_id().alias("id"))
    return asks.join(hits, ["scope", "name_lc"]).groupBy("team", "name").agg(_first_id().alias("player_id"))


def _contained(asks: DataFrame, roster: DataFrame) -> DataFrame:
    """Asks whose name is part of the labels of exactly one roster row.

    Rows are counted for each piece before the pieces meet the asks, so no list of candidates is ever built.
    """
    wanted = asks.select("scope", "name_lc").distinct()
    rows = roster.withColumn("_l", _lengths(wanted, "name_lc"))
    labels = F.concat(F.array("name_lc"), F.col("alts_lc"))
    pieces = F.array_distinct(F.flatten(F.transform(labels, lambda t: _pieces(t, F.col("_l")))))
    counts = (
        rows.select("id", "team_lc", F.explode(pieces).alias("name_lc"))
        .join(wanted.select("name_lc").distinct(), "name_lc", "left_semi")
        .select("id", "name_lc", _scopes().alias("scope"))
        .groupBy("scope", "name_lc")
        .agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("id"))
    )
    total = asks.join(counts, ["scope", "name_lc"]).groupBy("team", "name")
    total = total.agg(F.sum("n").alias("n"), F.min("id").alias("player_id"))
    return total.filter(F.col("n") == 1).drop("n")


def _with_tokens(df: DataFrame, text: str, q: int) -> DataFrame:
    """Add `tokens`: distinct pieces of q characters; single characters get their occurrence number, so repeats count."""
    last = F.length(text) - (q - 1)
    pieces = F.transform(F.sequence(F.lit(1), last), lambda i: F.col(text).substr(i, F.lit(q)))
    none = F.array().cast("array<string>")
    df = df.withColumn("tokens", F.when(last >= 1, F.array_distinct(pieces) if q > 1 else pieces).otherwise(none))
    if q > 1:
        return df

    def numbered(c: Column, i: Column) -> Column:
        return F.concat(c, F.size(F.filter(F.slice("tokens", 1, i + 1), lambda o: o == c)).cast("string"))

    return df.withColumn("tokens", F.transform("tokens", numbered))


def _lost(n: Column, q: int, cutoff: float) -> Column:
    """How many tokens of a text of `n` characters a partner at or above the cutoff may lack.

    The ratio is 2m/(a+b) for m characters in matching blocks. Single characters: b >= a*c/(2-c), so at least that many
    match. Longer pieces: at most D = 2a(1-c)/c characters of both texts are unmatched, blocks are D+1 at most, and
    each unmatched character and each gap between blocks spoils no more than q pieces together.
    """
    if q == 1:
        return (n - F.ceil(n * F.lit(cutoff / (2 - cutoff)) - 1e-9)).cast("int")
    return (_unmatched(n, cutoff) * q).cast("int")


def _rare_first(texts: DataFrame, keys: list[str], frequency: DataFrame) -> DataFrame:
    """Add `toks`, the tokens of each text from the rarest to the most common."""
    placed = (
        texts.select(*keys, F.explode("tokens").alias("token"))
        .join(frequency, "token", "left")
        .groupBy(*keys)
        .agg(F.array_sort(F.collect_list(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "token"))).alias("t"))
    )
    return placed.select(*keys, F.transform("t", lambda t: t["token"]).alias("toks"))


def _unmatched(n: Column, cutoff: float) -> Column:
    """How many characters of a text of `n` characters and of its partner may be unmatched together."""
    return F.floor(n * F.lit(2 * (1 - cutoff) / cutoff) + 1e-9)


def _less_one(text: Column) -> Column:
    """The text, and the text without any one of its characters."""
    n = F.length(text)
    shorter = F.transform(
        F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.concat(text.substr(F.lit(1), i - 1), text.substr(i + 1, n))
    )
    return F.array_distinct(F.concat(F.array(text), shorter))


def similar_pairs(names: DataFrame, labels: DataFrame, cutoff: float, q: int) -> DataFrame:
    """(scope, name, label) of all pairs that may reach the cutoff, from distinct (scope, name) and (scope, label).

    Matched characters are a common part of both texts in order. So short texts, of which one character may be unmatched,
    are equal, or equal when each leaves out one character at most: an equality join, with few pairs however many
    labels there are. Longer texts meet on their rarest tokens.
    """
    short = lambda text: _unmatched(F.length(text), cutoff) <= 1
    near = labels.filter(short("label")).withColumn("key", F.explode(_less_one(F.col("label"))))
    asked = names.filter(short("name")).withColumn("key", F.explode(_less_one(F.col("name"))))
    near = near.join(asked, ["scope", "key"]).select("scope", "name", "label").distinct()
    long_names, long_labels = names.filter(~short("name")), labels.filter(~short("label"))
    few = labels.filter(short("label")).join(long_names.select("scope").distinct(), "scope", "left_semi")
    pairs = near.unionByName(_token_pairs(names, long_labels, cutoff, q))
    return pairs.unionByName(_token_pairs(long_names, few, cutoff, q))


def _token_pairs(names: DataFrame, labels: DataFrame, cutoff: float, q: int) -> DataFrame:
    """(scope, name, label) that share enough tokens.

    Lossless prefix filter: texts that reach the cutoff share one of their rarest tokens. Pairs meet on those only, are
    kept only at the first token they share, and only if enough of all tokens agree.
    """
    texts, names = _with_tokens(labels, "label", q), _with_tokens(names, "name", q)
    frequency = texts.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("df"))

    def side(texts: DataFrame, text: str, s: str) -> DataFrame:
        ranked = _rare_first(texts, ["scope", text], frequency).withColumnRenamed("toks", f"t{s}")
        ranked = ranked.withColumn(f"l{s}", _lost(F.length(text), q, cutoff))
        ranked = ranked.withColumn(f"p{s}", F.slice(f"t{s}", 1, F.col(f"l{s}") + 1))
        return ranked.withColumn("token", F.explode(f"p{s}"))

    longer = F.greatest(F.length("label"), F.length("name"))
    shorter = F.least(F.length("label"), F.length("name"))
    common = F.size(F.array_intersect("ta", "tb"))
    enough = F.greatest(F.size("ta") - F.col("la"), F.size("tb") - F.col("lb"))
    if q == 1:
        enough = F.greatest(enough, F.ceil((longer + shorter) * F.lit(cutoff / 2) - 1e-9))
    return (
        side(texts, "label", "a")
        .join(side(names, "name", "b"), ["scope", "token"])
        .filter(shorter * 2 >= (longer + shorter) * cutoff - 1e-9)
        .filter(F.array_intersect("pb", "pa")[0] == F.col("token"))
        .filter(common >= enough)
        .select("scope", "name", "label")
    )


def similar_labels(asks: DataFrame, labels: DataFrame, cutoff: float = CUTOFF, q: int = 1) -> DataFrame:
    """Best label for each (scope, name): the highest difflib ratio at or above `cutoff`, then the last in text order.

    Only pairs that may reach the cutoff go to the ratio, see `similar_pairs`.
    """
    pairs = similar_pairs(asks.select("scope", "name").distinct(), labels.select("scope", "label").distinct(), cutoff, q)
    scored = pairs.select("scope", "name", "label", matching_ratio(F.col("label"), F.col("name")).alias("score"))
    return (
        scored.filter(F.col("score") >= cutoff)
        .groupBy("scope", "name")
        .agg(F.max(F.struct("score", "label")).alias("best"))
        .select("scope", "name", "best.score", "best.label")
    )


def _fuzzy(asks: DataFrame, roster: DataFrame, cutoff: float, q: int) -> DataFrame:
    """Asks with a similar label: the best label over all scopes, then its owner, names before aliases."""
    own = F.array(F.struct(F.col("name").alias("label"), F.lit(0).alias("kind")))
    also = F.transform("alts", lambda a: F.struct(a.alias("label"), F.lit(1).alias("kind")))
    labels = roster.select("id", "team_lc", F.explode(F.concat(own, also)).alias("l"))
    labels = labels.select("id", "l.label", "l.kind", _scopes().alias("scope"))
    labels = labels.join(asks.select("scope").distinct(), "scope", "left_semi")
    best = similar_labels(asks, labels, cutoff, q)
    first = F.min(F.struct("kind", F.length("id"), "id")).alias("owner")
    owner = labels.groupBy("scope", "label").agg(first)
    hits = asks.join(best, ["scope", "name"]).join(owner, ["scope", "label"])
    # Highest score, then last label, then first owner: one aggregate for each of the two steps.
    by_label = hits.groupBy("team", "name", "score", "label").agg(F.min("owner").alias("owner"))
    top = F.max_by(F.col("owner"), F.struct("score", "label"))
    return by_label.groupBy("team", "name").agg(top["id"].alias("player_id"))


def resolve_player(questions: DataFrame, roster: DataFrame, fuzzy: bool = True, cutoff: float = CUTOFF) -> DataFrame:
    """Questions with `player_id` and the `stage` that found it (1 exact, 2 contained, 3 similar; NULL if none).

    `questions` has `question`; `roster` is what read_roster gives. Everything runs on distinct (team, name) asks;
    what a step leaves over is written once, as several readers follow.
    """
    keys = ["team", "name"]
    asks = staged(_scoped_asks(_asks(questions), roster).select(*keys, "name_lc", "scope"))
    exact = staged(_exact(asks, roster))
    rest = staged(asks.join(exact, keys, "left_anti"))
    part = staged(_contained(rest, roster))
    solved = exact.withColumn("stage", F.lit(1)).unionByName(part.withColumn("stage", F.lit(2)))
    if fuzzy:
        rest = staged(rest.join(part, keys, "left_anti"))
        # Nearly equal names first: a match there is the best one, and few names need the wider search.
        steps = [(CLOSE, CLOSE_PIECE)] if cutoff < CLOSE else []
        for step, q in [*steps, (cutoff, 1)]:
            similar = staged(_fuzzy(rest, roster, step, q))
            solved = solved.unionByName(similar.withColumn("stage", F.lit(3)))
            rest = staged(rest.join(similar, keys, "left_anti"))
    return _asked(questions).join(solved, keys, "left").drop(*keys)
