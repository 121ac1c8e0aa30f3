"""Scores of report text against evidence, as column expressions."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidegraph.functions import facts

# Patterns and word lists of the checks.
IPV4 = r"\b(?:\d{1,3}\.){3}\d{1,3}\b"
MITRE = r"\bT\d{4}(?:\.\d{3})?\b"
NUMBER = r"(?<![\w.])\d[\d,]*(?:\.\d+)?(?!\s*%)(?!\w|\.\d)"
THOUSANDS_SPACE = "(?<=\\d)[\u202f\u00a0\u2009](?=\\d{3}(?!\\d))"
HEDGES = ("uncertain", "unclear", "may ", "might", "possibly", "could be", "not certain", "ambiguous", "likely", "appears", "suggests", "consistent with", "cannot be confirmed")
BORDERLINE_WORDS = ("borderline", "narrow", "just above", "only just", "barely", "marginal", "close to the threshold", "near the threshold", "slightly above", "uncertain", "low confidence", "not certain", "unclear", "may be", "might be", "possibly", "could be")
JARGON = ("neural network", "gnn", "graph neural", "embedding", "model was trained", "machine learning model", "logit", "softmax", "activation", "training data", "the algorithm")
LEAK = r"(?i)<think>|</think>|\bthe user (wants|asks|is asking)\b|\bwe need to (write|produce|output|draft) (an?|the) (incident )?(note|report)\b|\blet me (think|draft|write the)\b|\bmust not calculate\b"
SENTENCE_END = r"(?U)(?<=[.!?])\s+|\n+"
CONTRASTS = r";|\b(?:while|whereas|but|however|in contrast|on the other hand|conversely)\b"
FREE_NUMBERS = tuple(str(i) for i in range(11))


# How the parts of a column name may appear in prose; parts without words are passed over.
TOKEN_WORDS: dict[str, tuple[str, ...]] = {
    "l4": (), "num": (), "to": (), "up": (), "ipv4": (),
    "src": ("source", "src", "originating"),
    "dst": ("destination", "dst", "dest"),
    "in": ("in", "inbound", "incoming", "received"),
    "out": ("out", "outbound", "outgoing", "sent"),
    "pkts": ("packets", "packet", "pkts"),
    "pkt": ("packets", "packet", "pkt"),
    "proto": ("protocol", "proto"),
    "protocol": ("protocol", "proto"),
    "l7": ("application", "l7", "layer"),
    "avg": ("average", "avg", "mean"),
    "max": ("max", "maximum", "largest"),
    "min": ("min", "minimum", "smallest"),
    "win": ("window", "win"),
    "len": ("length", "len", "size"),
    "ret": ("return", "ret", "response"),
    "flags": ("flags", "flag"),
    "bytes": ("bytes", "byte"),
    "second": ("second", "sec"),
    "milliseconds": ("milliseconds", "ms", "millisecond", "duration"),
}

# Words that say which way a reason moved the score.
UP = ("raised", "raise", "increased", "increase", "pushed up", "pushed the score up", "contributed", "contributing", "drove", "driving", "supported", "supports", "supporting", "indicative of", "added to", "elevated", "boosted")
DOWN = ("lowered", "lower the", "lowering", "reduced", "reducing", "decreased", "decreasing", "pushed down", "pushed the score down", "counted against", "weighed against", "worked against", "argued against", "mitigat", "offset")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def found(text: Column, pattern: str) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))


def normal_number(n: Column) -> Column:
    """4,498 and 4498 and 4498.0 are one number."""
    plain = F.regexp_replace(n, ",", "")
    whole = F.regexp_replace(F.regexp_replace(plain, r"\.0*$", ""), r"^0+(?=\d)", "")
    part = F.regexp_replace(F.regexp_replace(plain, "0+$", ""), r"^0+(?=\d)", "")
    return F.when(plain.rlike(r"\.\d*[1-9]"), part).otherwise(whole)


def numbers(text: Column) -> Column:
    joined = F.regexp_replace(text, THOUSANDS_SPACE, "")
    every = F.transform(F.regexp_extract_all(joined, F.lit(NUMBER), F.lit(0)), normal_number)
    return F.array_except(F.array_distinct(every), F.array(*[F.lit(x) for x in FREE_NUMBERS]))


def entities(text: Column) -> Column:
    text = F.coalesce(text, F.lit(""))
    return F.struct(found(text, IPV4).alias("ips"), found(text, MITRE).alias("mitre"), numbers(text).alias("numbers"))


def evidence_entities(text: Column) -> Column:
    """What evidence supplies: its entities, those with underscores read as spaces, and numbers rounded to 0 to 3 places."""
    rounded = lambda n: let(n.cast("decimal(30,9)"), lambda x: F.array(*[normal_number(F.bround(x, p).cast("string")) for p in range(4)]))

    def both(a: Column, b: Column) -> Column:
        every = let(F.array_union(a["numbers"], b["numbers"]), lambda n: F.array_union(n, F.flatten(F.transform(n, rounded))))
        return F.struct(F.array_union(a["ips"], b["ips"]).alias("ips"), F.array_union(a["mitre"], b["mitre"]).alias("mitre"), every.alias("numbers"))

    return let(entities(text), lambda a: let(entities(F.regexp_replace(text, "_", " ")), lambda b: both(a, b)))


def groundedness(claimed: Column, supplied: Column) -> Column:
    """Share of claimed entities that evidence supplies, overall and by kind; NULL where nothing is claimed."""
    return let(F.struct(claimed.alias("claimed"), supplied.alias("supplied")), lambda x: _groundedness(x["claimed"], x["supplied"]))


def _groundedness(claimed: Column, supplied: Column) -> Column:
    kinds = ("ips", "mitre", "numbers")
    missing = {k: F.array_except(claimed[k], supplied[k]) for k in kinds}
    n = sum((F.size(claimed[k]) for k in kinds), F.lit(0))
    bad = sum((F.size(missing[k]) for k in kinds), F.lit(0))
    each = [F.when(F.size(claimed[k]) > 0, 1 - F.size(missing[k]) / F.size(claimed[k])).alias(f"{k}_grounded") for k in kinds]
    return F.struct(F.when(n > 0, 1 - bad / n).alias("grounded"), *each, n.alias("n_claims"), bad.alias("n_ungrounded"), F.array_sort(missing["ips"]).alias("fabricated_ips"), F.array_sort(missing["numbers"]).alias("ungrounded_numbers"))


def words_in(text: Column, words: tuple[str, ...]) -> Column:
    return F.array_sort(F.transform(F.filter(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(F.lower(text), w)), lambda w: F.trim(w)))


def conveyed(text: Column, words: tuple[str, ...], applies: Column) -> Column:
    """Whether a report says what it should, NULL where it need not."""
    return F.when(applies, F.size(words_in(text, words)) > 0)


def word_count(text: Column) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(r"\S+"), F.lit(0)))


def is_degenerate(text: Column) -> Column:
    tokens = F.size(F.regexp_extract_all(text, F.lit(r"\S+"), F.lit(0)))
    real = F.size(F.regexp_extract_all(text, F.lit("[A-Za-z]{2,}"), F.lit(0)))
    dots = F.length(text) - F.length(F.replace(text, F.lit("."), F.lit("")))
    return (tokens > 0) & ((real / tokens < 0.4) | (dots / F.greatest(F.length(text), F.lit(1)) > 0.2))


def leaked(text: Column) -> Column:
    return F.coalesce(text.rlike(LEAK), F.lit(False))


def families_named(text: Column, aliases: dict[str, tuple[str, ...]]) -> Column:
    """Families a report names by an alias between non-letters, longest aliases first; nested ones don't count. None in a NULL."""
    return F.array_sort(phrases_named(F.coalesce(text, F.lit("")), [(a, family) for family, names in aliases.items() for a in names]))


def phrases_named(text: Column, aliases: list[tuple[str, str]]) -> Column:
    """Labels of the aliases (phrase, label) that stand in a text as whole words; longest first, words that one takes are spent.

    The text is cut into words and what is between them once. Only words that begin an alias are looked at further: the
    pieces that follow, as many as aliases have, are looked up in one map, and hits are taken from long to short.
    """
    first_of = dict(reversed([(a.lower(), label) for a, label in aliases]))  # of equal aliases the first counts
    pieces_of = {a: re.findall("[a-z0-9]+|[^a-z0-9]+", a) for a in first_of}
    if any(not p or not p[0].isalnum() or not p[-1].isalnum() for p in pieces_of.values()):
        raise ValueError("an alias must begin and end with a letter or digit")
    order = sorted(dict.fromkeys(a.lower() for a, _ in aliases), key=lambda a: -len(a))
    ranks = F.create_map(*[x for k, a in enumerate(order) for x in (F.lit(a), F.lit(k))])
    labels = F.array(*[F.lit(first_of[a]) for a in order])
    begins = F.array(*[F.lit(w) for w in sorted({p[0] for p in pieces_of.values()})])
    lengths = F.array(*[F.lit(n) for n in sorted({len(p) for p in pieces_of.values()})])

    def hits(pieces: Column) -> Column:
        places = F.array_compact(F.transform(pieces, lambda p, i: F.when(F.array_contains(begins, p), i)))
        looked_up = lambda i, n: F.try_element_at(ranks, F.array_join(F.slice(pieces, i + 1, n), ""))
        each = F.transform(places, lambda i: F.transform(lengths, lambda n: F.struct(looked_up(i, n).alias("rank"), i.alias("a"), (i + n).alias("b"))))
        return F.array_sort(F.filter(F.flatten(each), lambda h: h["rank"].isNotNull()))

    def take(state: Column, h: Column) -> Column:
        free = ~F.exists(state, lambda t: (h["a"] < t["b"]) & (t["a"] < h["b"]))
        return F.when(free, F.concat(state, F.array(h))).otherwise(state)

    none = F.array().cast("array<struct<rank:int,a:int,b:int>>")
    found = let(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+|[^a-z0-9]+"), F.lit(0)), hits)
    return F.array_distinct(F.transform(F.aggregate(found, none, take), lambda t: F.get(labels, t["rank"])))


def classification_fidelity(named: Column, predicted: Column, distribution: Column, plausible: float = 0.05) -> Column:
    likely = F.array_union(F.map_keys(F.map_filter(distribution, lambda k, v: v >= plausible)), F.array(predicted))
    unsupported, says = F.array_except(named, likely), F.array_contains(named, predicted)
    return F.struct(says.alias("names_predicted"), F.array_sort(unsupported).alias("unsupported"), ((F.size(unsupported) > 0) & ~says).alias("substituted"), ((F.size(unsupported) == 0) & says).alias("faithful"))


def cites_feature(text: Column, column: str, options: dict[str, tuple[str, ...]] | None = None) -> Column:
    """Whether a report uses a column's name, or words for all its parts (``TOKEN_WORDS``) within one sentence."""
    low = F.lower(text)
    whole = F.contains(low, F.lit(column.lower())) | F.contains(low, F.lit(column.lower().replace("_", " ")))
    need = [(TOKEN_WORDS if options is None else options).get(part, (part,)) for part in column.lower().split("_")]
    need = [w for w in need if w]
    if not need:
        return whole
    sentences = F.transform(F.split(low, r"[.!?\n]+"), lambda s: F.regexp_extract_all(s, F.lit("[a-z0-9]+"), F.lit(0)))

    def every(words: Column) -> Column:
        out = None
        for w in need:
            hit = F.arrays_overlap(words, F.array(*[F.lit(x) for x in w]))
            out = hit if out is None else out & hit
        return out

    return whole | F.exists(sentences, every)


def citations(text: Column, shown: Column, columns: list[str], options: dict[str, tuple[str, ...]] | None = None) -> Column:
    """Which of the columns ``shown`` (an array of names out of ``columns``) a report cites: coverage, and whether none; NULL
    where nothing is shown."""
    shown = F.array_intersect(F.array(*[F.lit(c) for c in columns]), shown)
    cited = F.array_compact(F.array(*[F.when(cites_feature(text, c, options), F.lit(c)) for c in columns]))

    def of(own: Column, hit: Column) -> Column:
        return F.struct(F.size(own).alias("n_shown"), hit.alias("cited"), F.array_except(own, hit).alias("missed"), F.round(F.size(hit) / F.size(own), 4).alias("coverage"), (F.size(hit) == 0).alias("cites_none"))

    return let(shown, lambda own: F.when(F.size(own) > 0, let(F.array_intersect(own, cited), lambda hit: of(own, hit))))


def _marked_aliases(columns: dict[str, tuple[str, ...]]) -> tuple[list[tuple[str, str]], list[str]]:
    """Aliases from long to short, each with the mark of its column, and the columns in the order of their marks."""
    names = list(dict.fromkeys(c.removesuffix("_bucket") for c in columns))
    pairs = [(alias, chr(0xE000 + names.index(column.removesuffix("_bucket")))) for column, aliases in columns.items() for alias in aliases]
    return sorted(dict(reversed(pairs)).items(), key=lambda p: (-len(p[0]), p[0])), names


def mentioned_columns(clause: Column, columns: dict[str, tuple[str, ...]] = facts.ALIASES) -> Column:
    """Columns whose aliases stand anywhere in a lower-case clause, in order of the table; longest first, what one matches is
    spent. A bucket column counts as its column."""
    pairs, names = _marked_aliases(columns)
    table = F.array(*[F.struct(F.lit(a).alias("alias"), F.lit(m).alias("mark")) for a, m in pairs])
    marked = F.aggregate(table, clause, lambda rest, x: F.replace(rest, x["alias"], x["mark"]))
    marks = F.array(*[F.struct(F.lit(chr(0xE000 + i)).alias("mark"), F.lit(c).alias("column")) for i, c in enumerate(names)])
    return let(marked, lambda m: F.transform(F.filter(marks, lambda x: F.contains(m, x["mark"])), lambda x: x["column"]))


def clauses(text: Column) -> Column:
    """Lower-case clauses: sentences, which end at line ends and at blanks after a stop, cut at contrast words."""
    return F.flatten(F.transform(F.split(F.lower(F.coalesce(text, F.lit(""))), SENTENCE_END), lambda s: F.split(F.trim(s), CONTRASTS)))


def _said(words: tuple[str, ...]) -> Callable[[Column], Column]:
    return lambda clause: F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(clause, w))


def direction_fidelity(text: Column, reasons: Column, columns: dict[str, tuple[str, ...]] = facts.ALIASES) -> Column:
    """Whether a report keeps the direction of each reason it mentions; NULL without reasons.

    ``reasons`` is an array of (column, direction 'raised' or 'lowered'), of which the first of a column counts. In a clause
    whose direction words are all of one kind, every reason named has that direction. A bare TCP window is read only if one
    of both windows is a reason.
    """
    base = F.transform(reasons, lambda r: F.regexp_replace(r["column"], "_bucket$", ""))
    wins = F.array_intersect(F.array(F.lit("TCP_WIN_MAX_IN"), F.lit("TCP_WIN_MAX_OUT")), base)

    def of(clause: Column, known: Column, own: Column) -> Column:
        def checked(named: Column) -> Column:
            bare = F.array_contains(named, "TCP_WINDOW") & (F.size(own) == 1)
            read = F.when(bare, F.array_union(named, own)).otherwise(named)
            return F.array_sort(F.array_intersect(F.array_except(read, F.array(F.lit("TCP_WINDOW"))), known))

        says = F.when(_said(UP)(clause), "raised").otherwise("lowered")
        told = lambda c: F.get(reasons, F.array_position(known, c).cast("int") - 1)["direction"]
        return let(mentioned_columns(clause, columns), lambda named: F.transform(checked(named), lambda c: F.struct(c.alias("feature"), told(c).alias("evidence"), says.alias("report"), F.substring(F.trim(clause), 1, 160).alias("clause"))))

    one_sided = F.filter(clauses(text), lambda c: _said(UP)(c) != _said(DOWN)(c))
    every = let(base, lambda known: let(wins, lambda own: F.flatten(F.transform(one_sided, lambda c: of(c, known, own)))))

    def judged(found: Column) -> Column:
        errors = F.filter(found, lambda e: e["evidence"] != e["report"])
        return F.struct(F.size(found).alias("n_checked"), F.size(errors).alias("n_errors"), F.when(F.size(found) > 0, F.size(errors) == 0).alias("direction_faithful"), errors.alias("errors"))

    return F.when(F.coalesce(F.size(reasons), F.lit(0)) > 0, let(every, judged))
