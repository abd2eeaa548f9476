"""Turns that speak of the same thing, and the nearest of them before or after a turn.

Two turns of a tree share evidence if their tool calls touch the same file, if one names a file that the other touches, if
both have a word of a security surface, or if they have three words or more in common. Most turns share with one close by, so
looked_up() holds each against the turns within NEXT_DOOR of it, in one pass over the trees in order for all look-ups. Only trees
with turns that found nothing there, and that go on beyond, are looked through whole, by nearest(). All but common words are equal
keys there: what each key was last or next seen with comes from one pass over the key's turns in order, so no pairs are made.
Common words are looked for from the nearest turn outwards, in rounds that reach further, and only where nothing nearer is known;
turns that share words with none of a long tree are held against all turns that have one of their words.

nodes has tree, ord (unique in a tree), text, files (an array) and, where known, narration. Nulls are empty.

Fixed values: the words of surfaces.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import security as S
from ..functions import text as T
from ..functions.constraints import STOP_WORDS
from ..shared import cut, dealt

SURFACE_WORDS = (
    "auth", "session", "login", "signin", "signup", "oauth", "jwt", "sso", "saml",
    "secret", "secrets", "credential", "credentials", "password", "token", "apikey",
    "rbac", "permission", "permissions", "middleware", "crypto", "encrypt", "decrypt",
)
ACCEPTANCE = r"\b(?:that(?:'?s| is| works| fixed)|works now|looks? good|lgtm|perfect|great|nice|fixed|resolved|that did it|that worked|much better|exactly|correct now)\b"
REMEDY = r"\b(?:redact(?:s|ed|ing)?|mask(?:s|ed|ing)?|additive|non[\s-]?destructive|restor(?:e|es|ed|ing)|re[\s-]?seed|recover(?:s|ed|ing)?|lock(?:s|ed|ing)?\s*(?:it|this|that|things?|the\s+bucket)?\s*down|lockdown|allow[\s-]?list|fingerprint|rotat(?:e|es|ed|ing)|revok(?:e|es|ed|ing)|workload\s+identity|env\s+var|leave\s+it\s+alone|only\s+(?:a|the)\b)\b"
DATA = r"\b(?:seed(?:s|\s*data|\s*rows?)?|migrations?|tables?|schemas?|databases?|db|rows?|records?|indexe?s?|columns?|fixtures?|dumps?|backups?|datasets?|collections?)\b"
DATA_LOST = r"\b(?:blew\s+away|blow\s+away|dropped?|drop[\s-]?and[\s-]?recreate[d]?|truncate[d]?|wiped?|nuked?|deleted?|destroyed?|clobber(?:ed)?|overwr(?:ote|itten))\b"
DATA_BACK = r"\b(?:restore|re[\s-]?seed|recover|recreate|bring (?:it|them) back|non[\s-]?destructive|additive|preserve|put (?:it|them) back|undo|revert)\b"
LEAST_WORDS = 3
#: Letters by which file names are looked up; names have as many at least. Turns that the first round of common words looks through, and how many times as far each next one reaches.
GRAM, NEAR, FURTHER = 4, 16, 4
#: Turns on each side that a turn is held against one by one, and how many of them at a time until one is found.
NEXT_DOOR, AT_A_TIME = 64, (4, 12, 48)


def accepts(text: Column) -> Column:
    return T.matches(text, ACCEPTANCE)


def with_words(nodes: DataFrame) -> DataFrame:
    """nodes with words (distinct, of text, narration and paths of files), files and bases (file names of four letters or more)."""
    files = F.filter(F.coalesce("files", F.array().cast("array<string>")), lambda f: f.isNotNull() & (f != ""))
    said = F.coalesce(F.col("narration"), F.lit("")) if "narration" in nodes.columns else F.lit("")
    paths = F.array_join(F.transform(files, lambda f: F.regexp_replace(f, r"[\\/.+_-]+", " ")), " ")
    found = F.regexp_extract_all(F.lower(F.concat_ws(" ", F.coalesce("text", F.lit("")), paths, said)), F.lit(r"[a-z][a-z0-9_-]{2,}"), F.lit(0))
    bases = F.filter(F.transform(files, lambda f: F.lower(F.regexp_extract(f, r"([^\\/]*)$", 1))), lambda b: F.length(b) >= 4)
    return nodes.withColumns({"words": F.array_except(found, F.array(*map(F.lit, STOP_WORDS))), "files": F.array_distinct(files), "bases": F.array_distinct(bases)})


def naming(own: DataFrame) -> DataFrame:
    """(tree, ord, _b): the turns whose text has a tree's file name anywhere in it; own has bases.

    Names and texts meet by a name's first letters, which are among the runs of as many letters in the text, so that no turn
    is held against all names of its tree.
    """
    names = own.select("tree", F.explode("bases").alias("_b")).distinct().withColumn("_g", F.substring("_b", 1, GRAM))
    said = own.select("tree", "ord", F.lower(F.coalesce("text", F.lit(""))).alias("_t"))
    letters = said.withColumn("_l", F.split("_t", ""))
    runs = F.transform("_l", lambda c, i: F.concat(c, *(F.coalesce(F.get("_l", i + k), F.lit("")) for k in range(1, GRAM))))
    met = letters.select("tree", "ord", F.explode(F.array_distinct(runs)).alias("_g"))
    met = dealt(met, names, ["tree", "_g"]).select("tree", "ord", "_b")
    return dealt(met, said, ["tree", "ord"]).filter(F.contains("_t", F.col("_b"))).select("tree", "ord", "_b")


def keys(nodes: DataFrame) -> DataFrame:
    """(tree, ord, key, role): the keys of each turn; rows of roles 1 and 2 meet one another, rows of role 0 meet rows of role 0."""
    own = with_words(nodes)
    texts = naming(own)
    surface = F.array_intersect("words", F.array(*map(F.lit, SURFACE_WORDS)))
    row = lambda df, mark, name, role: df.select("tree", "ord", F.concat(F.lit(mark), F.col(name)).alias("key"), F.lit(role).alias("role"))
    return (
        row(own.select("tree", "ord", F.explode("files").alias("_f")), "f:", "_f", 0)
        .unionByName(row(own.select("tree", "ord", F.explode(surface).alias("_s")), "s:", "_s", 0))
        .unionByName(row(own.select("tree", "ord", F.explode("bases").alias("_b")), "b:", "_b", 1))
        .unionByName(row(texts, "b:", "_b", 2))
    )


class Evidence(NamedTuple):
    """What the turns of some trees have, written out once for all look-ups: keys() and (tree, ord, _w), the words of each turn."""

    keys: DataFrame
    words: DataFrame | None


def gathered(nodes: DataFrame) -> Evidence:
    return Evidence(cut(keys(nodes)), cut(with_words(nodes).select("tree", "ord", F.explode("words").alias("_w"))))


def by_words(words: DataFrame, askers: DataFrame, fit: DataFrame, met: DataFrame, after: bool) -> DataFrame:
    """(tree, id, found): the nearest fit turn that has LEAST_WORDS words in common, for askers that find one nearer than what they have met.

    Fit turns have places in their tree. Each round looks FURTHER times as far as the last, only for those who have found
    nothing yet and have nothing as near; a word's turns meet within cells as wide as the round's reach, so that common words,
    which find soon, cost their turns and not the square of them.
    """
    spots = fit.withColumn("_c", F.row_number().over(Window.partitionBy("tree").orderBy("ord")))
    held = cut(dealt(words, spots, ["tree", "ord"]).select("tree", "_w", "_c", F.col("ord").alias("found")))
    mark = spots.select("tree", F.col("ord").alias("at"), F.col("_c"), F.lit(None).cast("long").alias("id"))
    asked = mark.unionByName(askers.select("tree", "at", F.lit(None).cast("int").alias("_c"), F.col("id").cast("long").alias("id")))
    upto = Window.partitionBy("tree").orderBy("at").rangeBetween(Window.unboundedPreceding, 0 if after else -1)
    start = asked.withColumn("_p", F.coalesce(F.max("_c").over(upto), F.lit(0)) + (0 if after else 1)).filter("id is not null").select("tree", "id", "_p")
    known = dealt(met, spots.select("tree", F.col("ord").alias("found"), F.col("_c").alias("_k")), ["tree", "found"]).select("tree", "id", F.abs("_k").alias("_k"))
    most = spots.groupBy("tree").agg(F.max("_c").alias("_m"))
    own = dealt(dealt(dealt(askers.select("tree", "id", "ord"), start, ["tree", "id"]), most, ["tree"]), known, ["tree", "id"], "left")
    sign = 1 if after else -1
    far = F.when(F.col("_k").isNotNull(), F.abs(F.col("_k") - F.col("_p")) - 1).when(F.lit(after), F.col("_m") - F.col("_p")).otherwise(F.col("_p") - 1)
    own = cut(own.withColumn("_far", far).drop("_k", "_m"))
    out, low, high = None, 0, NEAR
    while True:
        # distances from low + 1 to high, in cells of high places: two at most
        reach = F.least(F.lit(high), F.col("_far"))
        ends = [F.col("_p") + sign * (low + 1), F.col("_p") + sign * reach]
        cells = F.array_distinct(F.transform(F.array(*ends), lambda c: F.floor(c / high)))
        left = dealt(own.filter(F.col("_far") > low), words, ["tree", "ord"]).withColumn("_cell", F.explode(cells))
        near = dealt(left, held.withColumn("_cell", F.floor(F.col("_c") / high)), ["tree", "_w", "_cell"])
        distance = sign * (F.col("_c") - F.col("_p"))
        common = near.filter((distance > low) & (distance <= reach) & (F.col("found") != F.col("ord"))).groupBy("tree", "id", "found").agg(F.count("*").alias("_n")).filter(F.col("_n") >= LEAST_WORDS)
        common = cut(common.groupBy("tree", "id").agg((F.min if after else F.max)("found").alias("found")))
        out = common if out is None else out.unionByName(common)
        own = cut(dealt(own.filter(F.col("_far") > high), common, ["tree", "id"], "leftanti"))
        if own.isEmpty():
            return out
        low, high = high, high * FURTHER


def nearest(nodes: DataFrame, askers: DataFrame, wanted: Column, after: bool = True, concrete_only: bool = False, known: Evidence | None = None) -> DataFrame:
    """(tree, id, found): for each asker the nearest wanted turn strictly after (or before) it that shares evidence with a turn, null if none does.

    askers has tree, id (unique in a tree), ord, the turn whose evidence counts, and at, the place after (or before) which it
    looks; wanted is a condition on nodes. With concrete_only common words don't count. The turn itself is never found.
    known is what gathered() has for nodes, if it is there already.
    """
    if known is None:
        known = Evidence(keys(nodes), None) if concrete_only else gathered(nodes)
    held = known.keys
    fit = nodes.filter(wanted).select("tree", "ord")
    can = dealt(held, fit, ["tree", "ord"]).select("tree", "key", "role", F.col("ord").alias("at"), F.col("ord").alias("_cand"), F.lit(None).cast("long").alias("id"), F.lit(None).cast("long").alias("_own"))
    other = F.when(F.col("role") == 0, 0).otherwise(3 - F.col("role"))
    ask = dealt(askers, held, ["tree", "ord"]).select("tree", "key", other.alias("role"), "at", F.lit(None).cast("long").alias("_cand"), F.col("id").cast("long").alias("id"), F.col("ord").cast("long").alias("_own"))
    sign = -1 if after else 1
    w = Window.partitionBy("tree", "key", "role").orderBy((sign * F.col("at")).alias("_o"))
    best = F.min if after else F.max
    # the range leaves out the place that is looked from
    first = best("_cand").over(w.rangeBetween(Window.unboundedPreceding, -1))
    met = can.unionByName(ask).withColumn("_n", first).filter("id is not null and _n is not null and _n <> _own").select("tree", "id", F.col("_n").alias("found"))
    out = met
    if not concrete_only:
        out = out.unionByName(by_words(known.words, askers, fit, met.groupBy("tree", "id").agg(best("found").alias("found")), after))
    nearest_found = out.groupBy("tree", "id").agg(best("found").alias("found"))
    return dealt(askers.select("tree", "id"), nearest_found, ["tree", "id"], "left")


def shares(a: Column, b: Column) -> Column:
    """Whether two turns share evidence; both are structs of files, bases, words, surface and said, the lower-case text."""
    named = F.exists(a["bases"], lambda n: F.contains(b["said"], n)) | F.exists(b["bases"], lambda n: F.contains(a["said"], n))
    return F.arrays_overlap(a["files"], b["files"]) | F.arrays_overlap(a["surface"], b["surface"]) | (F.size(F.array_intersect(a["words"], b["words"])) >= LEAST_WORDS) | named


def _first_shared(turns: Column, own: Column) -> Column:
    """The ord of the first of some turns that shares evidence, by few at a time."""
    found, at = [], 1
    for n in AT_A_TIME:
        found.append(F.try_element_at(F.filter(F.slice(turns, at, n), lambda t: shares(own, t)), F.lit(1))["ord"])
        at += n
    return F.coalesce(*found)


#: What is looked for: the turns that are wanted, and whether it is a later one; looked_up() has a column of each name.
LOOKED_FOR = {
    "correction": (lambda: (F.col("status") != "abandoned") & (F.col("kind") == "correction"), True),
    "secured": (lambda: (F.col("status") != "abandoned") & S.is_security_correction(F.col("text")), True),
    "later": (lambda: F.col("status") != "abandoned", True),
    "earlier": (lambda: F.col("status") != "abandoned", False),
}


def next_door(nodes: DataFrame, wanted: tuple[str, ...], keep: tuple[str, ...] = (), listed: bool = False) -> DataFrame:
    """(tree, ord, those of LOOKED_FOR that are wanted, on, back, secures, accepting, and nodes' columns of keep): the nearest turns of NEXT_DOOR that share evidence.

    on and back say whether the tree has turns beyond those that were looked at, secures whether the turn corrects something about
    security, and accepting is the next live turn that accepts. With listed, met has the ords of all live turns after it that
    were looked at and share evidence, in order. A turn is held against a fixed number of turns, however long its tree is.
    """
    live = F.col("status") != "abandoned"
    own = with_words(nodes).withColumns({"said": F.lower(F.coalesce("text", F.lit(""))), "surface": F.array_intersect("words", F.array(*map(F.lit, SURFACE_WORDS))), "secures": S.is_security_correction(F.col("text"))})
    own = own.withColumns({"_accepting": F.when(live & accepts(F.col("text")), F.col("ord")), "_turn": F.struct("ord", (F.col("kind") == "correction").alias("corrects"), "secures", "files", "bases", "words", "surface", "said")})
    own = own.select("tree", "ord", "secures", "_accepting", "_turn", live.alias("_live"), *keep)
    back = Window.partitionBy("tree").orderBy(F.col("ord").desc()).rowsBetween(Window.unboundedPreceding, -1)
    own = own.withColumn("accepting", F.min("_accepting").over(back)).drop("_accepting")
    w = Window.partitionBy("tree").orderBy("ord")
    frames = {"on": F.lead("ord", NEXT_DOOR + 1).over(w).isNotNull(), "back": F.lag("ord", NEXT_DOOR + 1).over(w).isNotNull()}
    one = F.when(F.col("_live"), F.col("_turn"))
    frames["_next"] = F.collect_list(one).over(w.rowsBetween(1, NEXT_DOOR))
    if "earlier" in wanted:
        frames["_last"] = F.collect_list(one).over(w.rowsBetween(-NEXT_DOOR, -1))
    own = own.withColumns(frames)
    turn, ahead = F.col("_turn"), F.col("_next")
    found = {
        "correction": lambda: _first_shared(F.filter(ahead, lambda t: t["corrects"]), turn), "secured": lambda: _first_shared(F.filter(ahead, lambda t: t["secures"]), turn),
        "later": lambda: _first_shared(ahead, turn), "earlier": lambda: _first_shared(F.reverse("_last"), turn),
    }
    met = [F.transform(F.filter(ahead, lambda t: shares(turn, t)), lambda t: t["ord"]).alias("met")] if listed else []
    return own.select("tree", "ord", "on", "back", "secures", "accepting", *(found[n]().alias(n) for n in wanted), *met, *keep)


def looked_up(nodes: DataFrame, wanted: tuple[str, ...], keep: tuple[str, ...] = (), listed: bool = False) -> DataFrame:
    """next_door(), with what is further away found as well; written out once for all look-ups. nodes has kind and status."""
    out = cut(next_door(nodes, wanted, keep, listed))
    if not wanted:
        return out
    open_ = {n: F.col(n).isNull() & F.col("on" if LOOKED_FOR[n][1] else "back") for n in wanted}
    left = out.agg(*(F.count_if(c).alias(n) for n, c in open_.items())).first()
    names = [n for n in wanted if left[n]]
    if not names:
        return out
    some = open_[names[0]]
    for n in names[1:]:
        some = some | open_[n]
    own = cut(dealt(nodes, out.filter(some).select("tree").distinct(), ["tree"], "left_semi"))
    known = gathered(own)
    for n in names:
        fit, after = LOOKED_FOR[n]
        asked = out.filter(open_[n]).select("tree", F.col("ord").alias("id"), "ord", F.col("ord").alias("at"))
        far = nearest(own, asked, fit(), after=after, known=known).filter("found is not null").select("tree", F.col("id").alias("ord"), F.col("found").alias("_far"))
        out = dealt(out, far, ["tree", "ord"], "left").withColumn(n, F.coalesce(n, "_far")).drop("_far")
    return cut(out)


def correction_after(nodes: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(tree, ord, corrector): the nearest later correction that shares evidence; nodes has kind and status. known is what looked_up() has for nodes, if it is there already."""
    known = looked_up(nodes, ("correction",)) if known is None else known
    return known.select("tree", "ord", F.col("correction").alias("corrector"))


def failure_target(nodes: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(tree, ord, target, linkage): the turn that a turn's complaint is about: the nearest earlier one that shares evidence (semantic), else the parent, else the one before (positional); abandoned ones never.

    nodes has parent (an ord), kind and status.
    """
    live = F.col("status") != "abandoned"
    known = looked_up(nodes, ("earlier",)) if known is None else known
    semantic = known.select("tree", "ord", F.col("earlier").alias("_semantic"))
    w = Window.partitionBy("tree").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    placed = nodes.withColumn("_last", F.max(F.when(live, F.col("ord"))).over(w)).select("tree", "ord", "parent", "_last")
    parents = nodes.filter(live).select("tree", F.col("ord").alias("parent"), F.lit(True).alias("_live"))
    own = dealt(dealt(placed, parents, ["tree", "parent"], "left"), semantic, ["tree", "ord"], "left")
    parent = F.when(F.col("_live") & (F.col("parent") < F.col("ord")), F.col("parent"))
    target = F.coalesce("_semantic", parent, "_last")
    return own.select("tree", "ord", target.alias("target"), F.when(F.col("_semantic").isNotNull(), "semantic").when(target.isNotNull(), "positional").alias("linkage"))


def accepted_after(nodes: DataFrame, failures: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(tree, id, accepted): for failures (tree, id, ord and corrector, an ord or null) the nearest turn after the corrector, or else the failure, that shares evidence with the failure; else the nearest that accepts.

    known is what looked_up() has for nodes with listed, if it is there already.
    """
    known = looked_up(nodes, (), listed=True) if known is None else known
    asked = failures.select("tree", F.col("id").cast("long").alias("id"), "ord", F.coalesce("corrector", "ord").alias("at"))
    near = F.try_element_at(F.filter("met", lambda o: o > F.col("at")), F.lit(1))
    asked = dealt(asked, known.select("tree", "ord", "met", "on"), ["tree", "ord"]).withColumn("_near", near)
    # turns before the one that is asked about aren't among those that it met
    asked = cut(asked.withColumn("_open", (F.col("_near").isNull() & F.col("on")) | (F.col("at") < F.col("ord"))).drop("met", "on"))
    own = asked.filter("not _open").select("tree", "id", "at", F.col("_near").alias("found"))
    far = asked.filter("_open").drop("_near", "_open")
    if not far.isEmpty():
        around = cut(dealt(nodes, far.select("tree").distinct(), ["tree"], "left_semi"))
        found = nearest(around, far, F.col("status") != "abandoned")
        own = own.unionByName(dealt(far.select("tree", "id", "at"), found, ["tree", "id"]))
    accepting = known.select("tree", F.col("ord").alias("at"), F.col("accepting"))
    return dealt(own, accepting, ["tree", "at"], "left").select("tree", "id", F.coalesce("found", "accepting").alias("accepted"))


def forward_chains(nodes: DataFrame, reach: int = 6) -> DataFrame:
    """(tree, failure, correction): for each failing turn the nearest of the next live turns, up to reach, that redirects and shares concrete evidence.

    nodes has kind, status, failing (whether it has a failure or rejection) and declined (whether it carries a decline).
    """
    w = Window.partitionBy("tree").orderBy("ord")
    live = nodes.filter("status <> 'abandoned'").withColumn("_rank", F.row_number().over(w))
    redirects = ((F.col("kind") == "correction") | F.col("declined")) & ~((F.col("kind") != "correction") & accepts(F.col("text")))
    asked = live.filter("failing").select("tree", F.col("ord").alias("id"), "ord", F.col("ord").alias("at"))
    found = nearest(live, asked, redirects, concrete_only=True).filter("found is not null")
    ranks = live.select("tree", "ord", "_rank")
    near = dealt(dealt(found, ranks.select("tree", F.col("ord").alias("id"), F.col("_rank").alias("_a")), ["tree", "id"]), ranks.select("tree", F.col("ord").alias("found"), F.col("_rank").alias("_b")), ["tree", "found"])
    return near.filter(F.col("_b") - F.col("_a") <= reach).select("tree", F.col("id").alias("failure"), F.col("found").alias("correction"))


def data_entities(text: Column) -> Column:
    """The distinct kinds of stored data that a text names, in the singular."""
    named = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(T.ascii_edges(DATA)), F.lit(0))
    one = lambda d: F.when(d.startswith("seed"), "seed").when(d.startswith("migration"), "migration").otherwise(F.regexp_replace(d, r"s\z", ""))
    return F.array_distinct(F.transform(named, one))


def backward_chains(nodes: DataFrame, reach: int = 10) -> DataFrame:
    """(tree, failure, correction): for each live turn that turns down or repairs something, the nearest of the live turns before it, up to reach, whose action it is about.

    It is about an action if both touch the same file or one names the other's; or if it wants data back, of a kind that the
    action's text or narration speaks of. A turn without files counts only if the later one has a word of a remedy. nodes has
    kind, status and declined; turns of more than 1,200 letters start no chain. Each of them meets reach turns at most.
    """
    text = F.coalesce("text", F.lit(""))
    w = Window.partitionBy("tree").orderBy("ord")
    live = with_words(nodes.withColumn("text", text)).filter("status <> 'abandoned'").withColumn("_rank", F.row_number().over(w))
    meant = ~T.matches(F.col("text"), S.FIGURATIVE) & ~T.matches(F.col("text"), S.NOT_THE_AGENT)
    redirects = ((F.col("kind") == "correction") | F.col("declined")) & ~((F.col("kind") != "correction") & accepts(F.col("text")))
    wants_back = meant & T.matches(F.col("text"), S.DESTRUCTIVE) & T.matches(F.col("text"), S.RECOVERY)
    entities = data_entities(F.col("text"))
    wants_data = meant & (F.size(entities) > 0) & T.matches(F.col("text"), DATA_LOST) & T.matches(F.col("text"), DATA_BACK)
    later = live.filter(F.length("text") <= 1200).withColumn("_data", F.when(wants_data, entities)).filter(redirects | F.col("declined") | wants_back | F.col("_data").isNotNull())
    later = later.filter("_rank > 1").select(
        "tree", F.col("ord").alias("correction"), F.lower("text").alias("_text"), F.col("files").alias("_files"), F.col("bases").alias("_bases"), "_data", T.matches(F.col("text"), REMEDY).alias("_remedy"),
        F.explode(F.sequence(F.greatest(F.lit(1), F.col("_rank") - reach), F.col("_rank") - 1)).alias("_rank"),
    )
    said = F.concat_ws(" ", "text", "narration") if "narration" in nodes.columns else F.col("text")
    prior = live.select("tree", "_rank", F.col("ord").alias("failure"), F.lower("text").alias("_said"), "files", "bases", data_entities(said).alias("_held"))
    acted = F.size("files") > 0
    tie = F.arrays_overlap("files", "_files") | F.exists("bases", lambda b: F.contains(F.col("_text"), b)) | F.exists("_bases", lambda b: F.contains(F.col("_said"), b))
    about = (tie & (F.col("_remedy") | acted)) | (acted & F.coalesce(F.arrays_overlap("_data", "_held"), F.lit(False)))
    met = dealt(later, prior, ["tree", "_rank"]).filter(about)
    return met.groupBy("tree", "correction").agg(F.max("failure").alias("failure")).select("tree", "failure", "correction")


def unique_chains(chains: DataFrame) -> DataFrame:
    """Chains numbered in the order of pass and place, one for each failure and correction, the first; chains has tree, failure, correction, pass and seq."""
    w = Window.partitionBy("tree", "failure", "correction").orderBy("pass", "seq")
    kept = chains.withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_k")
    numbered = kept.withColumn("_n", F.row_number().over(Window.partitionBy("tree").orderBy("pass", "seq", "failure", "correction")))
    text = F.col("_n").cast("string")
    return numbered.withColumn("chain_id", F.concat(F.lit("chain_"), F.when(F.length(text) < 3, F.lpad(text, 3, "0")).otherwise(text))).drop("_n")
