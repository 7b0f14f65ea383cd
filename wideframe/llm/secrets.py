"""Secrets in texts: fixed patterns, and weak candidates that count only beside a complementary part of a credential.

All of it is DataFrame work. One projection finds spans: the gaps between a pattern's matches and the matches themselves give
every position. Parts of credentials (identities, secrets, endpoints) then meet in an interval join over scopes: each part lies in
the buckets that its span touches, a weak candidate looks into the buckets of its scope.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..session import stage

#: Fixed patterns. Groups that are only for choice do not capture; group 1 is the value where a pattern has one.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
IDENTITY = r"""(?i:access_?key_?id|client_?id|user_?name|user_?id|account|login)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.@=-]+)"""
OPAQUE = r"[A-Za-z+/_-]*+[0-9][A-Za-z0-9+/_-]*"
ENDPOINT = r"""https?://[^\x20\x09-\x0D"'<>]+|[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?::[0-9]+)?"""
#: Least lengths: of an assigned value (6), of an access key (20) and of a hex run (24), the last two within the patterns.
LEAST_VALUE = 6
#: A weak opaque value has this many signs and capital, small and digit among them.
LEAST_OPAQUE = 16
#: Runs of the signs of ``OPAQUE``, of which those with a digit are its matches; a run is read once, also one without a digit.
RUN = r"[A-Za-z0-9+/_-]{16,}"
#: Parts belong together if at most so many code points lie between them.
SCOPE = 200
BUCKET = 512
#: Reported weak spans that may be broadcast (about 64 bytes each); more are joined by a shuffle.
BROADCAST_SPANS = 100_000

#: Matches or spans that are walked one by one from one place; longer lists are walked in blocks.
BLOCK = 256

KINDS = ("assign", "access", "hex", "identity", "opaque", "endpoint")
_SPAN = "array<struct<start:long,rank:int,stop:long,kind:string>>"


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, which is evaluated once however often the body names it."""
    return F.transform(F.array(value), body)[0]


def _blocks(items: Column) -> Column:
    """An array in slices of at most ``BLOCK`` elements; one empty slice for an empty array."""
    return F.transform(F.sequence(F.lit(0), F.greatest(F.size(items) - 1, F.lit(0)), F.lit(BLOCK)), lambda i: F.slice(items, i + 1, BLOCK))


def _before(values: Column, merge) -> Column:
    """For each element what ``merge`` makes of 0 and the elements before it; meant for one number per block."""
    zero = F.lit(0).cast("long")
    return F.transform(values, lambda _, i: F.aggregate(F.slice(values, 1, i), zero, merge))


def _spans(text: Column, pattern: str, kind: str, keep=None, group: int = 0) -> Column:
    """Leftmost non-overlapping matches as spans in code points, end exclusive; ``keep`` judges group ``group`` of a match.

    Positions are running sums of lengths. Blocks of matches are summed first and then walked one by one, each from its own
    place, since an array that grows by one element is copied each time.
    """
    gaps, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    rank = F.lit(KINDS.index(kind))

    def sizes(hits: Column, values: Column | None) -> Column:
        each = [F.slice(gaps, 1, F.size(hits)).alias("gap"), hits.alias("hit")] + ([values.alias("value")] if values is not None else [])
        return F.transform(F.arrays_zip(*each), lambda x: F.struct(
            F.char_length(x["gap"]).cast("long").alias("skip"), F.char_length(x["hit"]).cast("long").alias("long"),
            (keep(x["hit" if values is None else "value"]) if keep else F.lit(True)).alias("ok")))

    def add(state: Column, x: Column) -> Column:
        begin = state["place"] + x["skip"]
        span = F.struct(begin.alias("start"), rank.alias("rank"), (begin + x["long"]).alias("stop"), F.lit(kind).alias("kind"))
        spans = F.when(x["ok"], F.concat(state["spans"], F.array(span))).otherwise(state["spans"])
        return F.struct((begin + x["long"]).alias("place"), spans.alias("spans"))

    def walk(block: Column) -> Column:
        return F.aggregate(block["items"], F.struct(block["place"].alias("place"), F.array().cast(_SPAN).alias("spans")), add, lambda s: s["spans"])

    def placed(blocks: Column) -> Column:
        total = lambda b: F.aggregate(b, F.lit(0).cast("long"), lambda n, x: n + x["skip"] + x["long"])
        starts = _let(F.transform(blocks, total), lambda sums: _before(sums, lambda n, x: n + x))
        return F.flatten(F.transform(F.arrays_zip(blocks.alias("items"), starts.alias("place")), walk))

    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else None
    each = _let(hits, lambda h: sizes(h, values))
    found = _let(_let(each, _blocks), placed)
    return F.when(F.regexp_like(text, F.lit(pattern)), found).otherwise(F.array().cast(_SPAN))


def _opaque(value: Column) -> Column:
    return (F.char_length(value) >= LEAST_OPAQUE) & value.rlike("[0-9]") & value.rlike("[a-z]") & value.rlike("[A-Z]")


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def found_secrets(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """``doc_id, content, base, linked``, a row for each row of ``docs``, which needs ``doc_id`` and ``text``.

    ``base`` has the spans of the three fixed kinds, ``linked`` the weak candidates that a complementary part supports: an identity
    or an endpoint near a secret, or an opaque value near an identity or an endpoint. Secrets are assigned values, access keys
    beside their values, hex runs and opaque values; an access key is an identity. ``content`` is the MD5 of the text.

    A null text is an empty one and has no spans. Texts are searched whole. Equal texts are linked once, so repeated rows and
    large groups of copies add nothing to the join. Spans of different kinds may overlap. Other columns are ignored; no rows
    give none.
    """
    text = F.col("text")
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.select(
        "doc_id", F.md5("text").alias("content"),
        F.array_sort(F.concat(_spans(text, ASSIGN, "assign", lambda v: F.char_length(v) >= LEAST_VALUE, 1), _spans(text, ACCESS, "access"), _spans(text, HEX, "hex"))).alias("base"),
        F.concat(_spans(text, IDENTITY, "identity"), _spans(text, RUN, "opaque", _opaque), _spans(text, ENDPOINT, "endpoint")).alias("weak"))
    rows = stage(rows, "spans")

    # The parts of each distinct text, with what they are.
    role = F.when(F.col("kind").isin("access", "identity"), "identity").when(F.col("kind") == "endpoint", "endpoint").otherwise("secret")
    weak = F.col("kind").isin("identity", "opaque", "endpoint")
    parts = (rows.filter(F.size("weak") > 0).select("content", F.explode(F.concat("base", "weak")).alias("s")).select("content", "s.*").distinct()
             .withColumn("role", role))
    buckets = lambda low, high: F.explode(F.sequence(F.floor(F.greatest(low, F.lit(0)) / BUCKET), F.floor(high / BUCKET)))
    asking = parts.filter(weak).withColumn("bucket", buckets(F.col("start") - scope, F.col("stop") + scope)).alias("a")
    beside = parts.select("content", F.col("start").alias("p_start"), F.col("stop").alias("p_stop"), F.col("role").alias("p_role"),
                          buckets(F.col("start"), F.col("stop")).alias("bucket")).alias("b")
    near = (F.col("p_start") <= F.col("a.stop") + scope) & (F.col("p_stop") >= F.col("a.start") - scope)
    apart = (F.col("p_start") >= F.col("a.stop")) | (F.col("p_stop") <= F.col("a.start"))  # one value is not two parts
    fits = ((F.col("a.role") == "secret") & (F.col("p_role") != "secret")) | ((F.col("a.role") != "secret") & (F.col("p_role") == "secret"))
    kept = asking.join(beside, (F.col("a.content") == F.col("b.content")) & (F.col("a.bucket") == F.col("b.bucket")) & near & apart & fits, "left_semi")
    linked = (kept.select("content", F.struct("start", "rank", "stop", "kind").alias("s")).distinct()
              .groupBy("content").agg(F.array_sort(F.collect_list("s")).alias("linked")))
    linked = stage(linked, "linked")
    spans = linked.agg(F.sum(F.size("linked"))).first()[0] or 0
    linked = F.broadcast(linked) if spans <= BROADCAST_SPANS else linked
    return rows.select("doc_id", "content", "base").join(linked, "content", "left").select(
        "doc_id", "content", "base", F.coalesce("linked", F.array().cast(_SPAN)).alias("linked"))


def secret_digests(docs: DataFrame) -> DataFrame:
    """``doc_id``, counts of the base kinds, the digest of the base spans and all spans as text; see ``found_secrets``."""
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found_secrets(docs).select(
        "doc_id", count("assign"), count("access"), count("hex"), F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
        _joined(F.concat("base", "linked")).alias("spans"))


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """``text`` with the union of ``spans`` replaced by ``mark``, overlapping spans by one.

    A block of spans cuts its own piece out of the text and is replaced there, so a long text is read once per block, not per span.
    """
    def end(block: Column) -> Column:
        return F.aggregate(block, F.lit(0).cast("long"), lambda n, s: F.greatest(n, s["stop"]))

    def replaced(block: Column) -> Column:
        start, stop = block["place"], F.greatest(block["place"], end(block["items"]))
        piece = F.substring(text, (start + 1).cast("int"), (stop - start).cast("int"))

        def add(piece: Column):
            def one(state: Column, s: Column) -> Column:
                gap = F.substring(piece, (state["place"] - start + 1).cast("int"), F.greatest(s["start"] - state["place"], F.lit(0)).cast("int"))
                out = F.when(s["start"] >= state["place"], F.concat(state["out"], gap, F.lit(mark))).otherwise(state["out"])
                return F.struct(F.greatest(state["place"], s["stop"]).alias("place"), out.alias("out"))
            return one

        return _let(piece, lambda p: F.aggregate(block["items"], F.struct(start.alias("place"), F.lit("").alias("out")), add(p), lambda s: s["out"]))

    def whole(blocks: Column) -> Column:
        starts = _let(F.transform(blocks, end), lambda ends: _before(ends, lambda n, x: F.greatest(n, x)))
        last = F.aggregate(blocks, F.lit(0).cast("long"), lambda n, b: F.greatest(n, end(b)))
        parts = F.transform(F.arrays_zip(blocks.alias("items"), starts.alias("place")), replaced)
        return F.concat(F.array_join(parts, ""), F.substring(text, (last + 1).cast("int"), F.lit(2**31 - 1)))

    return F.when(F.size(spans) > 0, _let(_let(F.array_sort(spans), _blocks), whole)).otherwise(text)
