"""Personal data: fixed shapes, and identifiers found by bootstrapped contexts.

Base spans have fixed shapes (email, ip, card, phone). The bootstrap then treats every identifier-like token (a run of
identifier characters with a digit) as an instance and the two words before it, with the punctuation in between, as a
pattern; in these words any such token counts as the same word, so that lists of identifiers are patterns too. Tokens that
are base spans or long hexadecimal keys are the seeds. Scores go back and forth over the graph of patterns and instances: a
pattern scores by the share of its occurrences whose instance is trusted, an instance by the patterns that hold it; trusted
instances bring in further patterns in the next round. Occurrences are counted over the whole corpus, so that common word
pairs, which mostly precede other words, never become patterns. Tokens in patterns that end with a high score are reported
as kind "id". What a pattern needs doesn't depend on the size of the corpus.

A null text is empty. Rows that agree in id and text get equal results, one each. An empty table gives an empty result;
other columns are ignored. All offsets count code points. Whole texts are read; the expressions scan in linear time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss.llm.common import K, Scratch, keyed, unused

LOCAL = r"[A-Za-z0-9._%+-]"
#: Kinds in their order. A look-behind keeps the search from trying each place inside a run again; possessive
#: repetitions match the same and neither go back nor recurse.
KINDS = {
    "email": rf"(?:\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
ID = r"A-Za-z0-9._%+@:/-"
#: An identifier-like token: a whole run of identifier characters, six at least, with a digit.
TOKEN = rf"(?<![{ID}])(?=[{ID}]{{6}})[A-Za-z._%+@:/-]*+[0-9][{ID}]*+"
SECRET = r"^[0-9a-f]{32,}$"
ROUNDS = 5
#: Different trusted instances of a pattern, at any size of the corpus.
MIN_SEEDS = 3
#: What makes an instance as good as a seed.
MIN_TRUST = 0.5
MIN_SCORE = 0.5
#: Added to a pattern's occurrences, so that few of them prove little.
PRIOR = 1.0
#: Patterns that are broadcast at most.
BROADCAST = 1_000_000
SPAN = "array<struct<start:int,stop:int,kind:int,m:string>>"


def located(text: str, pattern: str, kind: int, keep: str) -> str:
    """SQL: the matches of a pattern that pass keep(m), with offsets, as SPAN. What lies between the matches is split off
    by the same pattern; running lengths of both give the offsets."""
    p = pattern.replace("\\", "\\\\").replace("'", "\\'")
    return f"""filter(aggregate(arrays_zip(split({text}, '{p}', -1), regexp_extract_all({text}, '{p}', 0)),
        named_struct('at', 0, 'out', cast(array() as {SPAN})),
        (a, x) -> if(x.`1` is null, a, named_struct('at', a.at + length(x.`0`) + length(x.`1`), 'out', concat(a.out,
            array(named_struct('start', a.at + length(x.`0`), 'stop', a.at + length(x.`0`) + length(x.`1`), 'kind', {kind}, 'm', x.`1`))))),
        a -> a.out), s -> {keep})"""


DIGITS = "regexp_replace(s.m, '[^0-9]', '')"
LUHN = f"""aggregate(transform(split(reverse({DIGITS}), ''), (c, i) -> if(i % 2 = 0, cast(c as int),
    if(cast(c as int) > 4, cast(c as int) * 2 - 9, cast(c as int) * 2))), 0, (a, c) -> a + c) % 10 = 0"""
KEEP = {
    "email": "true",
    "ip": "forall(split(s.m, '[.]'), p -> length(ltrim('0', p)) <= 3 and coalesce(cast(right(ltrim('0', p), 3) as int), 0) <= 255)",
    "card": f"length({DIGITS}) between 14 and 19 and {LUHN}",
    "phone": f"length({DIGITS}) between 10 and 15",
}
#: What a text must hold for a kind to occur at all.
NEED = {"email": "contains(text, '@')", "ip": "rlike(text, '[0-9][.][0-9]')", "card": "rlike(text, '[0-9][ -]?[0-9][ -]?[0-9]')", "phone": "rlike(text, '[+][0-9]')"}


def base_spans() -> Column:
    parts = [f"if({NEED[k]}, {located('text', p, i, KEEP[k])}, cast(array() as {SPAN}))" for i, (k, p) in enumerate(KINDS.items())]
    return F.expr(f"array_sort(concat({', '.join(parts)}), (a, b) -> case when a.start <> b.start then a.start - b.start else a.kind - b.kind end)")


#: Stands for an identifier-like token in the words of a text.
MARK = "\\u0001"
LEAD = "[^A-Za-z0-9\\u0001]*"


def marked_words(text: str) -> str:
    """SQL: the words of a text in lower case, with a mark in place of each identifier-like token."""
    p = TOKEN.replace("\\", "\\\\")
    return f"filter(split(lower(regexp_replace(replace({text}, '{MARK}', ' '), '{p}', '{MARK}')), '\\\\s+'), x -> x <> '')"


def instances() -> Column:
    """SQL array of start, stop, token and what stands before it: two words (marks among them) and punctuation. The k-th
    token is the k-th mark of the words."""
    p = TOKEN.replace("\\", "\\\\")
    spans = f"""aggregate(arrays_zip(split(text, '{p}', -1), regexp_extract_all(text, '{p}', 0)),
        named_struct('at', 0, 'out', cast(array() as array<struct<start:int,stop:int,token:string>>)),
        (a, x) -> if(x.`1` is null, a, named_struct('at', a.at + length(x.`0`) + length(x.`1`), 'out', concat(a.out, array(named_struct(
            'start', a.at + length(x.`0`), 'stop', a.at + length(x.`0`) + length(rtrim('.:/%+-', x.`1`)), 'token', lower(rtrim('.:/%+-', x.`1`))))))),
        a -> a.out)"""
    before = f"""transform(array({marked_words('text')}), w -> flatten(transform(w, (x, i) -> if(contains(x, '{MARK}'),
        transform(sequence(1, length(x) - length(replace(x, '{MARK}', ''))), k -> named_struct(
            'w1', coalesce(get(w, i - 2), ''), 'w2', coalesce(get(w, i - 1), ''), 'pre', substring_index(x, '{MARK}', k))),
        cast(array() as array<struct<w1:string,w2:string,pre:string>>)))))[0]"""
    item = "array<struct<start:int,stop:int,token:string,w1:string,w2:string,pre:string>>"
    return F.expr(f"""if(rlike(text, '[0-9]'), transform(arrays_zip({spans}, {before}), x -> named_struct('start', x.`0`.start, 'stop', x.`0`.stop, 'token', x.`0`.token,
        'w1', x.`1`.w1, 'w2', x.`1`.w2, 'pre', x.`1`.pre)), cast(array() as {item}))""")


P = ["w1", "w2", "pre"]


def occurrences(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """w1, w2, pre, seen: how often the wanted patterns occur at all, whatever follows."""
    hashes = f"transform(array({marked_words('text')}), w -> if(size(w) > 2, transform(sequence(0, size(w) - 3), i -> xxhash64(w[i], w[i + 1], regexp_extract(w[i + 2], '^{LEAD}', 0))), cast(array() as array<bigint>)))[0]"
    text = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    count = text.select(F.explode(F.expr(hashes)).alias("h")).groupBy("h").agg(F.count("*").alias("seen"))
    return count.join(wanted.withColumn("h", F.xxhash64(*P)), "h").select(*P, "seen")


def patterns(scratch: Scratch, docs: DataFrame, found: DataFrame) -> DataFrame:
    """w1, w2, pre, score of the patterns whose score is high.

    Each round takes in the patterns that MIN_SEEDS different trusted instances have: seeds, and what the patterns of the
    round before made trustworthy. So an instance that was found can bring in further patterns; rounds end when none comes
    in and no score moves, or after ROUNDS.
    """
    inst = found.select("doc_id", *K, F.explode("cand").alias("c"), "base").select(
        "c.*", (F.exists("base", lambda s: (s["start"] < F.col("c.stop")) & (s["stop"] > F.col("c.start"))) | F.col("c.token").rlike(SECRET)).alias("seed"))
    edges = inst.filter("w2 <> ''").groupBy(*P, "token").agg(F.count("*").alias("n"), F.max(F.col("seed").cast("int")).alias("seed"))
    edges = scratch.write(edges)
    wanted = scratch.write(edges.groupBy(*P).agg(F.count("*").alias("k"), F.max("seed").alias("s")).filter(F.col("k") >= MIN_SEEDS).select(*P))
    edges = scratch.write(edges.join(wanted, P))
    if wanted.count() <= BROADCAST:
        wanted = F.broadcast(wanted)
    seen = scratch.write(occurrences(docs, wanted))
    graph, before = edges.withColumn("s", F.col("seed").cast("double")), None
    for _ in range(ROUNDS):
        trusted = F.count(F.when(F.col("s") >= MIN_TRUST, 1))
        score = graph.groupBy(*P).agg(F.sum(F.col("s") * F.col("n")).alias("good"), F.sum("n").alias("n"), trusted.alias("trusted")).filter(F.col("trusted") >= MIN_SEEDS)
        score = score.join(seen, P, "left").select(*P, (F.col("good") / (F.greatest("n", F.coalesce("seen", F.lit(0))) + PRIOR)).alias("score"), "trusted")
        score = scratch.write(score)
        held = graph.select(*P, "token").join(score, P).groupBy("token").agg((1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("score"), F.lit(1e-9)))))).alias("t"))
        graph = scratch.write(edges.join(held, "token", "left").withColumn("s", F.when(F.col("seed") > 0, 1.0).otherwise(F.coalesce("t", F.lit(0.0)))).drop("t"))
        now = tuple(score.agg(F.count("*"), F.sum("trusted"), F.round(F.sum("score"), 3)).first())
        if now == before:
            break
        before = now
    return score.filter(F.col("score") >= MIN_SCORE)


def find(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, row key, base (spans) and spans (base and discovered ones, ordered by start, then kind) for each row."""
    scratch = Scratch(spark)
    found = scratch.write(keyed(docs).select("doc_id", *K, base_spans().alias("base"), instances().alias("cand")))
    good = patterns(scratch, docs, found)
    if good.count() <= BROADCAST:
        good = F.broadcast(good)
    new = found.filter(F.size("cand") > 0).select(*K, "base", F.explode("cand").alias("c")).select(*K, "base", "c.*").join(good, P)
    new = new.filter(~F.exists("base", lambda s: (s["start"] < F.col("stop")) & (s["stop"] > F.col("start"))))
    new = scratch.write(new.groupBy(*K).agg(F.collect_set(F.struct("start", "stop", F.lit(len(KINDS)).alias("kind"), F.col("token").alias("m"))).alias("new")))
    out = found.drop("cand").join(new, K, "left")
    return out.select("doc_id", *K, "base", F.expr(f"array_sort(concat(base, coalesce(new, cast(array() as {SPAN}))), (a, b) -> case when a.start <> b.start then a.start - b.start else a.kind - b.kind end)").alias("spans"))


def listed(spans: str) -> Column:
    names = F.array(*[F.lit(k) for k in (*KINDS, "id")])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["stop"])), ",")


def report(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, n_new, base_sha256, spans."""
    out = find(spark, docs)
    counts = [F.expr(f"cast(size(filter(base, s -> s.kind = {i})) as long)").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    new = (F.size("spans") - F.size("base")).cast("long").alias("n_new")
    return out.select("doc_id", *counts, new, F.sha2(listed("base"), 256).alias("base_sha256"), listed("spans").alias("spans"))


def redacted(text: Column, spans: str) -> Column:
    """The text with each stretch of spans replaced by its first kind in brackets."""
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in (*KINDS, "id")])
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def add(a: Column, s: Column) -> Column:
        inside = s["start"] < a["at"]
        more = F.concat(a["out"], F.substring(text, a["at"] + 1, s["start"] - a["at"]), F.get(names, s["kind"]))
        return F.struct(F.greatest(a["at"], s["stop"]).alias("at"), F.when(inside, a["out"]).otherwise(more).alias("out"))

    return F.aggregate(spans, start, add, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))))


def redact(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """All rows and columns of docs, texts redacted; n_chars, where there is one, follows the new text."""
    p1, p2, found, new = unused(docs, "p1", "p2", "spans", "new")
    spans = find(spark, docs).filter(F.size("spans") > 0).select(F.col("_k1").alias(p1), F.col("_k2").alias(p2), F.col("spans").alias(found)).dropDuplicates([p1, p2])
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    d = docs.join(spans.hint("merge"), (F.xxhash64(F.col("doc_id"), text) == F.col(p1)) & (F.hash(text, F.col("doc_id")) == F.col(p2)), "left")
    none = F.col(found).isNull()
    d = d.withColumn(new, F.when(none, F.col("text")).otherwise(redacted(F.col("text"), found)))
    changed = {"text": F.col(new)}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(none, F.col("n_chars")).otherwise(F.length(new)).cast(docs.schema["n_chars"].dataType)
    return d.select(*[changed[c].alias(c) if c in changed else F.col(f"`{c}`") for c in docs.columns])
