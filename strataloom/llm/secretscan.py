"""Secret scans by character Markov models, in DataFrame functions only.

Two first-order character models, of random strings and of ordinary identifiers, are trained from labelled
samples: transitions are counted per label, smoothed, and their log ratio becomes one table of numbers. A
candidate (a long run of key characters) is a secret where the summed log ratio of its transitions says that
the random model explains it better; else those of its parts are that do so, each a rise of the running sum up to
its top, widened to the letters, digits and '+' around it. Known formats are found by patterns beside it.

Places come from a pattern's matches and the parts between them, whose lengths add up to code points. All passes
over a text's matches are folds in chunks (see _fold), so time grows nearly in proportion to the text's length.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import log

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import LOWER, UPPER

# The known formats, in the order of their kinds.
ASSIGN = r"""((?i)password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"  # matches as AKIA[A-Z0-9]+ of 20 characters or more
HEX = r"[0-9a-f]{24,}"  # matches as [0-9a-f]+ of 24 or more
KINDS = ("assign", "access", "hex", "markov")
ASSIGN_VALUE = 6  # least characters of group 2

ALPHABET = LOWER + UPPER + "0123456789+/_=-"
N = len(ALPHABET)
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}"
CANDIDATE_CHARS = 20  # of a candidate's part as well
#: Least log-likelihood ratio of a secret: in all, and for each transition.
LEAST_RATIO, LEAST_MEAN = 12.0, 0.5
#: Labelled documents whose words are the ordinary sample, and random strings made for the other.
SAMPLE_DOCS, SAMPLE_RANDOM = 100, 4_000


@dataclass(frozen=True)
class MarkovModel:
    """log P(next | this, random) - log P(next | this, ordinary), at N * this + next."""

    ratios: tuple[float, ...]


def random_samples(spark: SparkSession, n: int = SAMPLE_RANDOM) -> DataFrame:
    """Strings labelled random: digests in base 64, its URL form, letters and digits, and either case of hex."""
    made = spark.range(n).select(F.sha2(F.col("id").cast("string").cast("binary"), 256).alias("h"))
    b64 = F.regexp_replace(F.base64(F.unhex("h")), "=+$", "")
    forms = (b64, F.translate(b64, "+/", "-_"), F.translate(b64, "+/", "xY"), F.upper("h"), F.col("h"))
    return made.select(F.explode(F.array(*forms)).alias("sample"), F.lit("random").alias("label"))


def ordinary_samples(docs: DataFrame, labels: DataFrame, n: int = SAMPLE_DOCS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Identifiers labelled ordinary: neighbouring words of n good documents, joined as programmers join them."""
    good = labels.where("quality = 1").select(F.col("doc_id").alias("i")).distinct().orderBy("i").limit(n)
    texts = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).join(F.broadcast(good), "i", "left_semi")
    words = F.filter(F.split("t", "[^A-Za-z]+"), lambda w: F.length(w) > 0)
    pairs = texts.select(F.explode(F.arrays_zip(words.alias("a"), F.slice(words, 2, F.size(words)).alias("b"))).alias("p")).select(
        F.col("p.a").alias("a"), F.col("p.b").alias("b")
    ).dropna()
    forms = ("a", F.concat_ws("_", "a", "b"), F.concat("a", F.initcap("b")), F.concat_ws("-", "a", "b"), F.concat_ws("/", "a", "b"), F.upper(F.concat_ws("_", "a", "b")))
    return pairs.select(F.explode(F.array(*[F.col(f) if isinstance(f, str) else f for f in forms])).alias("sample"), F.lit("ordinary").alias("label"))


def _kind(i: int) -> int:
    """Lower case, upper case, digit or sign."""
    return 0 if i < 26 else 1 if i < 52 else 2 if i < 62 else 3


KIND_SIZES = (26, 26, 10, N - 62)


def _transitions(counts: list[int]) -> list[float]:
    """P(next | this), smoothed with that of the characters' kinds: rare pairs of letters are still letters."""
    kinds = [[1.0] * 4 for _ in range(4)]
    for a in range(N):
        for b in range(N):
            kinds[_kind(a)][_kind(b)] += counts[a * N + b]
    out = []
    for a in range(N):
        row = counts[a * N : a * N + N]
        weight = 10 + 0.1 * sum(row)
        back = [x / sum(kinds[_kind(a)]) for x in kinds[_kind(a)]]
        out += [(c + weight * back[_kind(b)] / KIND_SIZES[_kind(b)]) / (sum(row) + weight) for b, c in enumerate(row)]
    return out


def train(samples: DataFrame) -> MarkovModel:
    """samples has sample and label (random or ordinary). Driver memory: at most 2 * N * N counts."""
    chars = F.split("sample", "")
    steps = samples.where("length(sample) > 1").select("label", F.explode(F.arrays_zip(chars.alias("a"), F.slice(chars, 2, F.size(chars)).alias("b"))).alias("p"))
    at = steps.where("p.b is not null").select("label", *[F.instr(F.lit(ALPHABET), F.col(f"p.{c}")).alias(c) for c in ("a", "b")])
    counts = {"random": [0] * N * N, "ordinary": [0] * N * N}
    for r in at.where("a > 0 and b > 0").groupBy("label", "a", "b").count().collect():
        counts[r["label"]][(r["a"] - 1) * N + r["b"] - 1] = r["count"]
    odds = {k: _transitions(v) for k, v in counts.items()}
    ratios = [log(x) - log(y) for x, y in zip(odds["random"], odds["ordinary"], strict=True)]
    return MarkovModel(tuple(ratios))


#: Elements of a chunk of a fold.
CHUNK = 1_024


def _let(name: str, value: str, body: str) -> str:
    """SQL: body, in which name is a value that is evaluated once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _fold(items: str, fields: dict[str, tuple[str, str]], emit: str, kind: str) -> str:
    """SQL: what `emit` (an array of `kind`) gives for each x of the items, one behind another.

    fields has the running values acc.name, each with its first and its next value. What is found is collected per
    chunk and the chunks are joined at the end: appending to one long array would copy it for each match.
    """
    none = f"cast(array() as array<{kind}>)"
    last = "cast(greatest(size(v) - 1, 0) / {CHUNK} as int)".replace("{CHUNK}", str(CHUNK))
    chunks = _let("v", items, f"transform(sequence(0, {last}), c -> slice(v, c * {CHUNK} + 1, {CHUNK}))")
    carried = ", ".join(f"'{f}', o.{f}" for f in fields)
    onward = ", ".join(f"'{f}', {following}" for f, (_, following) in fields.items())
    inner = f"aggregate(q, named_struct({carried}, 'found', {none}), (acc, x) -> named_struct({onward}, 'found', concat(acc.found, {emit})))"
    result = ", ".join(f"'{f}', r.{f}" for f in fields)
    step = _let("r", inner, f"named_struct({result}, 'outs', array_append(o.outs, r.found))")
    start = ", ".join(f"'{f}', {first}" for f, (first, _) in fields.items())
    return f"aggregate({chunks}, named_struct({start}, 'outs', cast(array() as array<array<{kind}>>)), (o, q) -> {step}, o -> flatten(o.outs))"


SPAN = "struct<s:int,k:int,e:int>"
MATCH = "struct<s:int,k:int,e:int,m:string>"


def _matches(pattern: str, kind: int, least: int, group: int = 0) -> str:
    """SQL: places and texts of a pattern's matches in column t whose group has `least` characters, in order."""
    p = "r'" + pattern.replace("'", "\\x27") + "'"
    parts = f"arrays_zip(split(t, {p}, -1), regexp_extract_all(t, {p}, 0), regexp_extract_all(t, {p}, {group}))"  # fields 0, 1, 2
    none = f"cast(array() as array<{MATCH}>)"
    found = f"array(named_struct('s', acc.at + length(x.`0`), 'k', {kind}, 'e', acc.at + length(x.`0`) + length(x.`1`), 'm', x.`1`))"
    fields = {"at": ("0", "acc.at + length(x.`0`) + coalesce(length(x.`1`), 0)")}
    return f"if(t rlike {p}, {_fold(parts, fields, f'if(coalesce(length(x.`2`), 0) >= {least}, {found}, {none})', MATCH)}, {none})"


def _spans(matches: str) -> str:
    return f"transform({matches}, c -> named_struct('s', c.s, 'k', c.k, 'e', c.e))"


def _rises(least_ratio: float, least_mean: float) -> str:
    """SQL: the parts of a candidate c (codes, pieces, r beside it) that are rises of the running sum, as spans.

    A rise ends where the sum is spent or far below its top. Signs between names are no evidence for a part, only
    against it. b and zs are where the runs of letters, digits and '+' begin that hold its first character and its
    top's; the latter run is the zq-th of pieces. Each part is widened to these runs. One step more than there are
    transitions ends the last rise.
    """
    step = "if(codes[x.i] >= 63 or codes[x.i + 1] >= 63, least(r[x.i], 0D), r[x.i])"
    items = f"transform(sequence(0, size(r)), i -> {_let('x', 'named_struct(' + repr('i') + ', i)', f'named_struct({chr(39)}i{chr(39)}, i, {chr(39)}r{chr(39)}, if(i = size(r), double({chr(39)}-Infinity{chr(39)}), {step}))')})"
    fresh, over = "acc.sum <= 0", f"(acc.sum + x.r <= 0 or acc.sum + x.r < acc.top - {least_ratio}D)"
    higher = "acc.sum + x.r > acc.top"
    sign = "x.i < size(r) and codes[x.i + 1] >= 63"
    fields = {
        "sum": ("0D", f"case when {fresh} then x.r when {over} then 0D else acc.sum + x.r end"),
        "top": ("0D", f"case when {fresh} then x.r when {over} then 0D else greatest(acc.top, acc.sum + x.r) end"),
        "b": ("0", f"if({fresh}, acc.run, acc.b)"),
        "zs": ("0", f"if({fresh} or {higher}, acc.run, acc.zs)"),
        "zq": ("0", f"if({fresh} or {higher}, acc.q, acc.zq)"),
        "run": ("if(codes[0] >= 63, 1, 0)", f"if({sign}, x.i + 2, acc.run)"),
        "q": ("if(codes[0] >= 63, 1, 0)", f"if({sign}, acc.q + 1, acc.q)"),
    }
    end = "acc.zs + length(pieces[acc.zq])"
    good = f"acc.top >= {least_ratio}D and {end} - acc.b >= {CANDIDATE_CHARS} and acc.top >= {least_mean}D * ({end} - acc.b - 1)"
    emit = f"if(not ({fresh}) and {over} and {good}, array(named_struct('s', c.s + acc.b, 'k', 3, 'e', c.s + {end})), cast(array() as array<{SPAN}>))"
    return _fold(items, fields, emit, SPAN)


def scan_secrets(
    docs: DataFrame,
    model: MarkovModel,
    id_col: str = "doc_id",
    text_col: str = "text",
    least_ratio: float = LEAST_RATIO,
    least_mean: float = LEAST_MEAN,
    mask: str = "[SECRET]",
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """Find secrets: id_col, base, spans, redacted, carry. A narrow pass without Python.

    base and spans are arrays of {s, k, e}: start and end (exclusive) in code points and the place of the kind
    in KINDS, by start and kind; spans also has those of the Markov models, where they overlap no base span.
    redacted is the text with each secret masked (overlapping ones once). Null texts have no spans and stay
    null; empty ones have none; very long ones, in any script, take time in proportion; repeated rows are each
    scanned; columns not named are not read.
    """
    table = ",".join(f"{r:.6g}" for r in model.ratios)
    chosen = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("own"), F.coalesce(F.col(text_col), F.lit("")).alias("t"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(carry)])
    known = [_spans(_matches(*m)) for m in ((ASSIGN, 0, ASSIGN_VALUE, 2), (ACCESS, 1, 20), (HEX, 2, 24))]
    base = f"array_sort(concat({', '.join(known)}))"
    whole = f"aggregate(r, 0D, (sum, x) -> sum + x) >= greatest({least_ratio}D, {least_mean}D * size(r))"
    judged = f"if({whole}, array(named_struct('s', c.s, 'k', c.k, 'e', c.e)), {_let('pieces', 'split(c.m, ' + repr('[/_=-]') + ', -1)', _rises(least_ratio, least_mean))})"
    ratios = f"transform(sequence(1, size(codes) - 1), i -> ratios[codes[i - 1] * {N} + codes[i]])"
    scored = _let("codes", f"transform(split(c.m, ''), x -> instr('{ALPHABET}', x) - 1)", _let("r", ratios, judged))
    markov = f"flatten(transform({_matches(CANDIDATE, 3, 1)}, c -> {scored}))"
    # Markov spans that begin before an earlier base span has ended go, and repeated ones; then those with a base span's start inside
    none = f"cast(array() as array<{SPAN}>)"
    forth = _fold(
        f"array_sort(concat(base, {markov}))",
        {"end": ("0", "if(x.k < 3, greatest(acc.end, x.e), acc.end)"), "last": (f"cast(null as {SPAN})", "x")},
        f"if(x.k < 3 or (x.s >= acc.end and not (x <=> acc.last)), array(x), {none})",
        SPAN,
    )
    back = _fold(f"reverse({forth})", {"start": ("2147483647", "if(x.k < 3, least(acc.start, x.s), acc.start)")}, f"if(x.k < 3 or x.e <= acc.start, array(x), {none})", SPAN)
    # kept parts lie between masks; of overlapping spans the first one is masked up to the last one's end
    gap = "struct<s:int,e:int>"
    gaps = _fold(
        "array_append(spans, named_struct('s', length(t), 'k', 9, 'e', length(t)))",
        {"at": ("0", "greatest(acc.at, x.e)")},
        f"if(x.s >= acc.at, array(named_struct('s', acc.at, 'e', x.s)), cast(array() as array<{gap}>))",
        gap,
    )
    kept = f"transform({gaps}, g -> array_join(slice(chars, g.s + 1, g.e - g.s), ''))"
    redacted = f"if(size(spans) = 0, own, {_let('chars', 'split(t, ' + repr('') + ')', f'array_join({kept}, {chr(39)}{mask}{chr(39)})')})"
    return (
        chosen.withColumn("ratios", F.split(F.lit(table), ",").cast("array<double>"))
        .withColumn("base", F.expr(base))
        .withColumn("spans", F.expr(f"if(size(base) = 0 and not (t rlike r'{CANDIDATE}'), {none}, reverse({back}))"))
        .withColumn("redacted", F.expr(redacted))
        .select(F.col("id").alias(id_col), "base", "spans", "redacted", *[F.col(f"c{i}").alias(c) for i, c in enumerate(carry)])
    )


def span_list(spans: str) -> Column:
    """kind:start:end of each, comma-joined."""
    names = ", ".join(f"'{k}'" for k in KINDS)
    return F.expr(f"array_join(transform({spans}, x -> concat(element_at(array({names}), x.k + 1), ':', x.s, ':', x.e)), ',')")


def span_count(spans: str, kind: str) -> Column:
    return F.expr(f"cast(size(filter({spans}, x -> x.k = {KINDS.index(kind)})) as bigint)")
