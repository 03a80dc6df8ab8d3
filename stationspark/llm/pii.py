"""Personal data by candidate gradient boosting, in DataFrame functions only (operator 1).

Generators of high recall propose spans that may overlap: the base formats and looser ones of the same kinds. Base spans
always stay. Looser candidates are rated by boosted trees over format and context features, and a threshold per kind selects
which are added. The trees learn from examples made of all base spans that there are: each is rewritten as people write
such data to hide it or in a hurry (label 1), and into look-alikes such as times, versions and order numbers (label 0). The
checks of the base formats (digit sums, ranges of numbers, numbers of digits) are no features. Thresholds are set on documents
that the trees have not seen, where what is selected must be right in a stated share.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table, text_or_empty
from .trees import Node, as_column, parse

KINDS = ("email", "ip", "card", "phone")
#: One document in FOLDS is held out for thresholds.
FOLDS = 4
#: Up to WHOLE examples Spark ML looks at all of them for its splits, with BINS values of a feature; of more it looks at the square
#: of the number of bins, which then grows with them so that it is all. A task learns from about TASK_ROWS.
WHOLE, BINS, TASK_ROWS = 10_000, 32, 50_000
TREES, DEPTH = 30, 4
#: What share of the selected candidates must be right in the held-out documents, and what a threshold is at least.
PRECISION, LEAST = 0.95, 0.5
BESIDE = 24

# The base formats, written so that a match takes time in proportion to its length: runs are possessive and an attempt
# starts only where a run does (or where the last match ended), which finds the same leftmost matches.
_LOCAL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++"
BASE = {
    "email": _LOCAL + r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# Looser formats of the same kinds, and what a text must contain for one to be looked for.
LOOSE = [
    ("email", _LOCAL + r"\x20?[\[(](?:at|AT)[\])]\x20?[A-Za-z0-9-]++(?:(?:\x20?[\[(](?:dot|DOT)[\])]\x20?|\.)[A-Za-z0-9-]++)++", r"[\[(](?:at|AT)[\])]"),
    ("email", _LOCAL + r"\x20(?:at|AT)\x20[A-Za-z0-9-]++(?:\x20(?:dot|DOT)\x20[A-Za-z0-9-]++)++", r"\x20(?:dot|DOT)\x20"),
    ("email", _LOCAL + r"(?:\x20@\x20|&#64;)[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", r"\x20@\x20|&#64;"),
    ("ip", r"(?<![0-9])[0-9]{1,5}(?:[\[(]\.[\])][0-9]{1,5}){3}(?![0-9])", r"[0-9][\[(]\.[\])]"),
    ("ip", r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])", r"[0-9A-Fa-f]:[0-9A-Fa-f]"),
    ("ip", r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6}(?![0-9A-Za-z:])", r"[0-9A-Fa-f]::[0-9A-Fa-f]"),
    ("card", r"(?<![0-9])[0-9]{4}(?:[._/][0-9]{4}){2}[._/][0-9]{1,7}(?![0-9])", r"[0-9][._/][0-9]"),
    ("phone", r"(?<![0-9+(])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])", r"[0-9]{3}[\x20.-][0-9]{4}"),
    ("phone", r"(?<![0-9+(])00[1-9][0-9]{0,2}(?:[\x20./-]{1,2}\(?[0-9]{1,7}\)?){2,5}(?![0-9])", r"00[1-9]"),
    ("phone", r"(?<![0-9+(.])\(?0[1-9][0-9]{1,4}\)?(?:\x20?[/-]\x20?|\x20)[0-9]{4,8}(?!-?[0-9])", r"0[1-9][0-9]{1,4}\)?[\x20/-]"),
]
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
#: Words beside a span that speak for each kind, and for something else (fixed values).
_WORDS = {
    "email": "mail|contact|write|reach", "ip": "ip|address|host|server|addr", "card": "card|visa|credit|debit|payment|pay",
    "phone": "phone|tel|call|mobile|cell|fax|sms|whatsapp",
}
_AGAINST = "order|ref|version|no|isbn|build|date|time|part|item|meet|see"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once, as the variable of a lambda over one element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def prefix_sums(lengths: Column) -> Column:
    """For each element the sum of those before it, by blocks of the square root of their number."""

    def block(part: Column, start: Column) -> Column:
        zero = F.struct(start.alias("total"), F.array().cast("array<bigint>").alias("sums"))
        return F.aggregate(part, zero, lambda a, x: F.struct((a["total"] + x).alias("total"), F.array_append(a["sums"], a["total"]).alias("sums")))

    def whole(values: Column) -> Column:
        step = F.ceil(F.sqrt(F.size(values))).cast("int")
        starts = F.when(F.size(values) > 0, F.sequence(F.lit(1), F.size(values), F.greatest(step, F.lit(1)))).otherwise(F.array().cast("array<int>"))
        blocks = F.transform(starts, lambda i: F.slice(values, i, F.greatest(step, F.lit(1))))
        zero = F.struct(F.lit(0).cast("long").alias("total"), F.array().cast("array<array<bigint>>").alias("parts"))
        done = F.aggregate(blocks, zero, lambda a, b: let(block(b, a["total"]), lambda r: F.struct(r["total"].alias("total"), F.array_append(a["parts"], r["sums"]).alias("parts"))))
        return F.flatten(done["parts"])

    return let(lengths, whole)


def digits_of(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the check: from the right, every second digit doubled, digits of it added."""
    each = F.split(F.reverse(digits), "(?<=.)(?=.)")
    value = F.transform(each, lambda d, i: let(d.cast("int") * (1 + i % 2), lambda v: F.when(v > 9, v - 9).otherwise(v)))
    return F.aggregate(value, F.lit(0), lambda a, v: a + v) % 10 == 0


def valid(kind: str, match: Column) -> Column:
    """The checks of a base format."""
    n = F.length(digits_of(match))
    if kind == "ip":
        return match.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    if kind == "card":
        return F.when(n.between(12, 19), luhn(digits_of(match))).otherwise(F.lit(False))
    return n.between(9, 15) if kind == "phone" else F.lit(True)


def _features(kind: str, match: Column, before: Column, after: Column) -> Column:
    """Format and context as numbers."""
    digits, n = digits_of(match), F.length(match)
    count = lambda p: n - F.length(F.regexp_replace(match, p, ""))
    beside = lambda words: before.rlike(rf"(?i)\b(?:{words})\W*$").cast("int")
    groups = F.transform(F.split(match, "[^0-9]+"), lambda g: F.length(g))
    numbers = [
        F.lit(KINDS.index(kind)), n, F.length(digits), F.length(digits) / n, count(r"[\x20]"), count("[.]"), count("-"), count("[()]"), count(r"[\[\]]"), count(":"),
        count("/"), count("@"), F.substring(digits, 2, 1).try_cast("int"), count("[A-Za-z]"), F.array_max(groups), F.size(groups), F.size(F.array_distinct(F.split(digits, "(?<=.)(?=.)"))), F.substring(digits, 1, 1).try_cast("int"),
        F.length(F.regexp_extract(match, "([A-Za-z]*)$", 1)), before.rlike(r"\w$").cast("int"), after.rlike(r"^\w").cast("int"), beside(_WORDS[kind]), beside(_AGAINST),
    ]
    return F.array(*[F.coalesce(x.cast("double"), F.lit(-1.0)) for x in numbers])


FEATURES = 23
CANDIDATE = "array<struct<start:bigint,kind:int,end:bigint,base:boolean,good:boolean,x:array<double>>>"


def located(text: Column, pattern: str, needs: str | None, use: Callable[[Column], Column]) -> Column:
    """``use`` of each match of a generator in a text, in order: its match, what stands beside it, start and end in code points."""

    def spans(found: Column) -> Column:
        pieces = F.split(text, pattern, -1)

        def placed(gaps: Column) -> Column:
            heads = F.slice(gaps, 1, F.size(found))
            tails = F.slice(gaps, 2, F.size(found))
            sizes = F.zip_with(heads, found, lambda g, m: (F.char_length(g) + F.char_length(m)).cast("long"))
            context = F.zip_with(heads, tails, lambda g, t: F.struct(F.char_length(g).cast("long").alias("gap"), F.substring(g, -BESIDE, BESIDE).alias("before"), F.substring(t, 1, 8).alias("after")))
            where = F.zip_with(prefix_sums(sizes), context, lambda s, c: F.struct((s + c["gap"]).alias("start"), c["before"].alias("before"), c["after"].alias("after")))
            whole = F.zip_with(
                where, found, lambda w, m: F.struct(w["start"].alias("start"), (w["start"] + F.char_length(m)).alias("end"), m.alias("match"), w["before"].alias("before"), w["after"].alias("after"))
            )
            return F.transform(whole, use)

        return let(pieces, placed)

    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    matches = F.when(text.rlike(needs), matches) if needs else matches
    return let(matches, lambda found: F.when(F.size(found) > 0, spans(found)))


def proposed(text: Column, kind: str, pattern: str, needs: str | None, base: bool) -> Column:
    """A generator's candidates in a text. Base ones are checked, others get their features."""

    def candidate(c: Column) -> Column:
        good = valid(kind, c["match"]) if base else F.lit(False)
        x = F.lit(None).cast("array<double>") if base else _features(kind, c["match"], c["before"], c["after"])
        return F.struct(c["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), c["end"].alias("end"), F.lit(base).alias("base"), good.alias("good"), x.alias("x"))

    return F.coalesce(located(text, pattern, needs, candidate), F.array()).cast(CANDIDATE)


def _needs(kind: str) -> str:
    return "@" if kind == "email" else r"\+[0-9]" if kind == "phone" else "[0-9]"


def candidates(text: Column) -> Column:
    """Candidates of all generators."""
    base = [proposed(text, k, p, _needs(k), True) for k, p in BASE.items()]
    return F.flatten(F.array(*base, *[proposed(text, k, p, needs, False) for k, p, needs in LOOSE]))


def score(trees: list[Node], x: Column) -> Column:
    """Probability of a feature vector: the logistic of twice the margin, as the boosted trees' loss has it."""
    features = [F.get(x, F.lit(k)) for k in range(FEATURES)]
    margin = sum((as_column(t, features) for t in trees[1:]), as_column(trees[0], features))
    return 1 / (1 + F.exp(-2 * margin))


def rewritten(kind: str, m: Column) -> list[tuple[int, Column, bool]]:
    """A base span as it may be written otherwise (1), and look-alikes made of it (0), and whether only a word beside it can tell which."""
    digits = digits_of(m)
    fours = lambda x, by: F.regexp_replace(x, "(.{4})(?=.)", f"$1{by}")
    if kind == "email":
        local, host = F.substring_index(m, "@", 1), F.substring_index(m, "@", -1)
        plain = F.concat(F.lit("a"), F.regexp_replace(local, "[^a-z]", ""))
        near = F.substring_index(host, ".", -2)
        ways = [(" [at] ", " [dot] "), ("(at)", "."), ("(at)", "(dot)"), (" at ", " dot "), (" @ ", "."), ("&#64;", ".")]
        # Look-alikes begin with the plain part, so real ones do as well: what stands before the sign does not tell.
        real = [F.concat(a, F.lit(at), F.replace(b, F.lit("."), F.lit(dot))) for at, dot in ways for a, b in ((local, host), (plain, near))]
        other = [F.concat(plain, F.lit(end)) for end in (" (at) 5.30", " [at] v2.0", " @ 5.30", " @ v2.0", " at 2 dot 5", " at version 2 dot 0")]
        return [(1, x, False) for x in real] + [(0, x, False) for x in other]
    if kind == "ip":
        pairs = F.regexp_replace(F.rpad(digits, 16, "1"), "(.{2})(?=.)", "$1:")
        groups = F.regexp_replace(m, r"\.", ":")
        scope = F.regexp_replace(F.translate(F.rpad(digits, 6, "1"), "0123456789", "abcdefaced"), "^(.{1,3})(.{3}).*$", "$1::$2")
        real = [F.regexp_replace(m, r"\.", "[.]"), F.concat(F.lit("2001:db8:0:0:"), groups), F.concat(F.lit("2001:db8::"), groups), F.concat(F.lit("fe80::"), F.substring_index(groups, ":", -2))]
        other = [F.regexp_replace(m, r"([0-9]+)\.", "20$1[.]"), pairs, scope, F.concat(F.substring(scope, 1, 1), F.lit("::"), F.substring(scope, -2, 2))]
        return [(1, x, False) for x in real] + [(0, x, False) for x in other]
    if kind == "card":
        shifted, stamp = F.translate(digits, "3456", "0189"), F.concat(F.lit("20"), F.substring(digits, 3, 11))
        return [(label, fours(x, by), False) for by in "._" for label, x in ((1, digits), (0, shifted), (0, stamp))]
    short = F.regexp_replace(F.substring(digits, -10, 10), "^(.{3})(.{3})(.*)$", "$1-$2-$3")
    trunk = F.concat(F.lit("0"), F.substring(digits, 2, 2), F.lit("/"), F.substring(digits, -7, 7))
    spaced = F.concat(F.lit("(0"), F.substring(digits, 2, 3), F.lit(") "), F.substring(digits, -6, 6))
    serial = F.concat(F.lit("00"), F.substring(digits, 2, 1), F.lit("-20"), F.substring(digits, 3, 2), F.lit("-0"), F.substring(digits, 5, 1), F.lit("-1"), F.substring(digits, 6, 1))
    always = [(1, short), (0, short), (0, F.translate(short, "-", ".")), (1, trunk), (0, trunk), (1, spaced), (0, F.translate(spaced, "()", ""))]
    free = [(1, F.regexp_replace(m, r"^\+[0-9]{1,3}[\x20.-]?", "")), (1, F.regexp_replace(m, r"^\+", "00")), (0, serial)]
    return [(*x, False) for x in free] + [(*x, True) for x in always]


def examples(text: Column, kind: str) -> Column:
    """kind, label and x for rewritten base spans of a text; every second one, and those that are alike but for that, beside a word."""

    def of(c: Column) -> Column:
        made = []
        for k, (label, match, ambiguous) in enumerate(rewritten(kind, c["match"])):
            words = F.array(*map(F.lit, (_WORDS[kind] if label else _AGAINST).split("|")))
            at = F.xxhash64(c["match"], F.lit(k))
            beside = F.concat(c["before"], F.get(words, F.pmod(at, F.size(words)).cast("int")), F.lit(" "))
            before = beside if ambiguous else F.when(F.shiftright(at, 9) % 2 == 0, beside).otherwise(c["before"])
            said = F.struct(F.lit(float(label)).alias("label"), match.alias("m"), before.alias("b"), c["after"].alias("a"))
            made.append(let(said, lambda v: F.struct(F.lit(KINDS.index(kind)).alias("kind"), v["label"].alias("label"), _features(kind, v["m"], v["b"], v["a"]).alias("x"))))
        return F.when(valid(kind, c["match"]), F.array(*made))

    return F.flatten(F.filter(located(text, BASE[kind], _needs(kind), of), lambda v: v.isNotNull()))


def holders(docs: DataFrame) -> DataFrame:
    """doc_id, text and kinds of all documents with base spans: the numbers of the kinds that they hold."""
    holds = lambda kind: F.exists(F.coalesce(located(text_or_empty(), BASE[kind], _needs(kind), lambda c: valid(kind, c["match"])), F.array(F.lit(False))), lambda v: v)
    kinds = F.array_compact(F.array(*[F.when(holds(kind), k) for k, kind in enumerate(KINDS)]))
    return docs.where(F.col("doc_id").isNotNull()).select("doc_id", text_or_empty().alias("text"), kinds.alias("kinds")).where(F.size("kinds") > 0)


def training(docs: DataFrame, most: int | None = None) -> DataFrame:
    """kind, label, x and fold: examples made of the base spans of all documents; where ``most`` is given, of that many at most.

    Those are, of all documents that hold a base span of a kind, an equal number for each kind with the smallest hashed ids.
    """
    texts = materialize(holders(docs), "pii-holders")  # few of all; what examples are made of is looked for in no other text
    if most is not None:
        each = -(-most // len(KINDS))
        chosen = [texts.where(F.array_contains("kinds", k)).select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(each) for k in range(len(KINDS))]
        texts = texts.join(F.broadcast(reduce(DataFrame.union, chosen).distinct()), "doc_id")  # bounded
    made = [F.coalesce(examples(F.col("text"), kind), F.array()).cast("array<struct<kind:int,label:double,x:array<double>>>") for kind in KINDS]
    fold = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(FOLDS)).alias("fold")
    return texts.select(fold, F.explode(F.flatten(F.array(*made))).alias("e")).select("fold", "e.*")


def train(docs: DataFrame, most: int | None = None) -> tuple[list[Node], dict[int, float]]:
    """(trees, threshold per kind) from ``training`` examples of all folds but the last, which sets the thresholds.

    A kind's threshold is the lowest from which PRECISION of the held-out examples above it are right; a kind that has none
    gets no threshold. Without examples of both labels there are no trees, and nothing is added to the base spans. Examples
    that are alike are one row with their number as weight.
    """
    rows = materialize(training(docs, most).groupBy("fold", "kind", "label", "x").agg(F.count("*").alias("n")), "pii-training")
    seen, held = rows.where(F.col("fold") < FOLDS - 1), rows.where(F.col("fold") == FOLDS - 1)
    found = seen.groupBy("label").agg(F.sum("n").alias("n"), F.count("*").alias("rows")).collect()
    sizes, distinct = {r["label"]: r["n"] for r in found}, sum(r["rows"] for r in found)
    if len(sizes) < 2:
        return [], {}
    weight = F.when(F.col("label") > 0, 0.5 / sizes[1.0]).otherwise(0.5 / sizes[0.0]) * sum(sizes.values())
    ready = seen.coalesce(max(2, distinct // TASK_ROWS)).select("label", (weight * F.col("n")).alias("w"), array_to_vector("x").alias("features"))
    bins = BINS if distinct <= WHOLE else math.ceil(math.sqrt(distinct))
    model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, maxBins=bins, weightCol="w", seed=7, stepSize=0.3).fit(ready)
    trees = [_scaled(t, w) for t, w in zip(parse(model.toDebugString), model.treeWeights, strict=True)]
    level = F.floor(score(trees, F.col("x")) * 100).cast("int")
    levels = held.groupBy("kind", level.alias("level")).agg(F.sum(F.col("label") * F.col("n")).alias("right"), F.sum("n").alias("n"))
    found = {(r["kind"], r["level"]): (r["right"], r["n"]) for r in levels.collect()}  # a hundred rows a kind at most
    thresholds: dict[int, float] = {}
    for kind in range(len(KINDS)):
        right = n = 0.0
        for at in range(100, round(100 * LEAST) - 1, -1):
            more = found.get((kind, at), (0.0, 0))
            right, n = right + more[0], n + more[1]
            if n and right >= PRECISION * n:
                thresholds[kind] = at / 100
    return trees, thresholds


def _scaled(node: Node, weight: float) -> Node:
    if node.feature < 0:
        return Node(value=node.value * weight)
    return Node(feature=node.feature, threshold=node.threshold, low=_scaled(node.low, weight), high=_scaled(node.high, weight))


def _listed(spans: Column) -> Column:
    """kind:start:end by start, then kind, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    ordered = F.sort_array(F.transform(spans, lambda c: F.struct(c["start"], c["kind"], c["end"])))
    return F.array_join(F.transform(ordered, lambda c: F.concat_ws(":", F.get(names, c["kind"]), c["start"], c["end"])), ",")


def apart(base: Column, added: Column) -> Column:
    """The added spans that overlap no base one. Base spans are looked at by blocks of the square root of their number."""
    overlaps = lambda a, b: (a["start"] < b["end"]) & (b["start"] < a["end"])

    def blocks(spans: Column) -> Column:
        step = F.greatest(F.ceil(F.sqrt(F.size(spans))).cast("int"), F.lit(1))
        starts = F.when(F.size(spans) > 0, F.sequence(F.lit(1), F.size(spans), step)).otherwise(F.array().cast("array<int>"))
        whole = lambda part: F.struct(F.array_min(part)["start"].alias("start"), F.array_max(F.transform(part, lambda b: b["end"])).alias("end"), part.alias("part"))
        return F.transform(starts, lambda i: let(F.slice(spans, i, step), whole))

    ordered = F.sort_array(F.transform(base, lambda b: F.struct(b["start"].alias("start"), b["end"].alias("end"))))
    free = lambda of: F.filter(added, lambda c: ~F.exists(of, lambda block: overlaps(block, c) & F.exists(block["part"], lambda b: overlaps(b, c))))
    return let(let(ordered, blocks), free)


def find_personal_data(docs: DataFrame, trees: list[Node], thresholds: dict[int, float]) -> DataFrame:
    """Per row: doc_id, n_email, n_ip, n_card, n_phone, base_sha256 and spans (base ones and those that the trees add).

    Null text is the empty text, which has no spans. Rows are independent: no shuffle; repeated rows give repeated results, a
    null id stays null, other columns are ignored, an empty table gives no rows. Added spans never overlap a base one.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), candidates(text_or_empty()).alias("found"))

    def counted(base: Column, added: Column) -> Column:
        free = F.when(F.size(added) > 0, apart(base, added)).otherwise(added)
        of = lambda k: F.size(F.filter(base, lambda c: c["kind"] == k))
        n = [of(k).cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS)]
        return F.struct(*n, F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.concat(base, free)).alias("spans"))

    def selected(c: Column) -> Column:
        if not trees or not thresholds:
            return F.lit(False)
        at = F.try_element_at(F.create_map(*[F.lit(x) for kv in thresholds.items() for x in kv]), c["kind"])
        return ~c["base"] & F.coalesce(score(trees, c["x"]) >= at, F.lit(False))

    def parted(found: Column) -> Column:
        return let(F.filter(found, lambda c: c["base"] & c["good"]), lambda base: let(F.filter(found, selected), lambda added: counted(base, added)))

    out = let(F.col("found"), parted)
    return rows.select("doc_id", out.alias("r")).select("doc_id", "r.*")


def op1_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return find_personal_data(docs, *train(docs))
