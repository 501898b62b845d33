"""Secrets in text, in DataFrame functions only.

Base kinds (always reported): assign (a keyword, = or :, a value of 8 or more characters), access (an access
identifier of 16 or more), hex (a run of 32 or more).

The method links the parts of multipart credentials. Weak candidates mean nothing alone: ident (other providers' identifiers: temporary
access keys, OAuth client ids), key40 (a bare run of exactly 40 base64 characters, with digits and letters of both cases), secret (other
providers' secret formats) and endpoint (a service URL), none of them where a base span lies. A scope is the text within SCOPE_CHARS of an
identifier, access or ident. A key40 or secret is reported if an identifier lies in scope; an ident if a key40, secret or assign does; an endpoint
if an identifier and one of these do.

One pass over the texts writes their spans; from then on only spans move. Those of the few texts that hold an identifier and a
weak part become rows, interval joins by text and block of SCOPE_CHARS characters clear and link them, and the links return to their
texts' rows. A text's work grows with the number of its spans, however dense they are.

Null and empty texts have no spans; an empty table gives no rows; rows with a null id are kept. Repeated rows give one result row each.
Other columns of the input play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenlake.llm.common import cut

BASE_KINDS = ("assign", "access", "hex")
WEAK_KINDS = ("ident", "key40", "secret", "endpoint")
SCOPE_CHARS = 400
#: Matches that are placed together, so that a text with very many takes no quadratic time.
CHUNK = 64
# The patterns of each kind, in Java's syntax.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
IDENT = r"(?<![A-Za-z0-9])ASIA[A-Z0-9]{16}(?![A-Za-z0-9])|(?<![0-9])[0-9]{6,20}-[a-z0-9]{32}\.apps\.googleusercontent\.com"
KEY40 = r"(?<![A-Za-z0-9+/_.-])(?=[A-Za-z+/]{0,39}[0-9])(?=[A-Z0-9+/]{0,39}[a-z])(?=[a-z0-9+/]{0,39}[A-Z])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/_.=-])"
SECRET = r"(?<![A-Za-z0-9])GOCSPX-[A-Za-z0-9_-]{28}(?![A-Za-z0-9_-])|(?<![A-Za-z0-9+/_.-])[A-Za-z0-9+/]{86}==(?![A-Za-z0-9+/=])"
ENDPOINT = r"https?://[A-Za-z0-9.-]{1,253}(?::[0-9]{1,5})?"
SPAN = "struct<start:int,kind:string,end:int>"


def _bound(value: Column, use) -> Column:  # noqa: ANN001
    """use(value), with value worked out once however often use mentions it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _spans(text: Column, kind: str, pattern: str, keep_group: int | None = None, least: int = 0) -> Column:
    """Array of (start, kind, end) of a pattern's matches, by start; start leads so that arrays sort by place.

    What lies between the matches, and the matches, add up to the positions. Matches whose keep_group has
    fewer than least characters are dropped after the search, so they still use up their text.
    """
    between = F.split(text, pattern, -1)
    whole = F.regexp_extract_all(text, F.lit(f"({pattern})"), 1)
    group = F.regexp_extract_all(text, F.lit(pattern), keep_group) if keep_group else whole
    none = F.array().cast(f"array<{SPAN}>")

    def step(acc: Column, z: Column) -> Column:
        begin = acc["at"] + F.length(z["gap"])
        end = begin + F.length(z["hit"])
        span = F.struct(begin.cast("int").alias("start"), F.lit(kind).alias("kind"), end.cast("int").alias("end"))
        return F.struct(end.cast("int").alias("at"), F.when(F.length(z["group"]) >= least, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    def placed(z: Column) -> Column:
        def chunk(acc: Column, i: Column) -> Column:
            inner = F.aggregate(F.slice(z, i * CHUNK + 1, CHUNK), F.struct(acc["at"].alias("at"), none.alias("out")), step)
            return _bound(inner, lambda r: F.struct(r["at"].alias("at"), F.concat(acc["out"], F.array(r["out"])).alias("out")))

        begin = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<array<{SPAN}>>").alias("out"))
        return F.aggregate(F.sequence(F.lit(0), F.floor((F.size(z) - 1) / CHUNK).cast("int")), begin, chunk, lambda acc: F.flatten(acc["out"]))

    zipped = F.filter(F.arrays_zip(between.alias("gap"), whole.alias("hit"), group.alias("group")), lambda z: z["hit"].isNotNull())
    return F.when(text.rlike(pattern), _bound(zipped, placed)).otherwise(none)


def _blocks(rows: DataFrame, first: Column, last: Column) -> DataFrame:
    """The rows once for each block of SCOPE_CHARS characters from that of first to that of last."""
    at = lambda c: F.floor(c / SCOPE_CHARS).cast("long")
    return rows.withColumn("block", F.explode(F.sequence(at(first), at(last))))


def _links(found: DataFrame) -> DataFrame:
    """key, and the weak spans of each key that link to complementary parts within their scopes."""
    rows = found.select("key", "base", "weak").dropDuplicates(["key"])
    base = rows.select("key", F.explode("base").alias("p")).select("key", "p.*")
    weak = rows.select("key", F.explode("weak").alias("p")).select("key", "p.*")
    start, end = F.col("start"), F.col("end")
    # Weak parts where no base span lies.
    taken = _blocks(base, start, end - 1).select("key", "block", start.alias("s"), end.alias("e"))
    over = _blocks(weak, start, end - 1).join(taken, ["key", "block"]).where((start < F.col("e")) & (F.col("s") < end))
    clear = weak.join(over.select("key", "kind", "start").distinct(), ["key", "kind", "start"], "left_anti")
    parts = base.unionByName(clear)
    # Identifiers with what lies in their scopes.
    idents = parts.where("kind in ('access', 'ident')").select("key", start.alias("a"), end.alias("b"), F.col("kind").alias("ident"))
    idents = _blocks(idents, F.col("a") - SCOPE_CHARS, F.col("b") + SCOPE_CHARS)
    others = _blocks(parts.where("kind not in ('access', 'ident', 'hex')"), start, end - 1)
    near = (start < F.col("b") + SCOPE_CHARS) & (end > F.col("a") - SCOPE_CHARS)
    linked = others.join(idents, ["key", "block"]).where(near).select("key", "start", "kind", "end", "a", "b", "ident").distinct()
    secret = F.col("kind").isin("assign", "key40", "secret")
    complete = linked.where(secret).select("key", "a", "b", "ident").distinct()
    endpoints = linked.where("kind = 'endpoint'").join(complete.select("key", "a"), ["key", "a"], "left_semi")
    named = complete.where("ident = 'ident'").select("key", F.col("a").alias("start"), F.col("ident").alias("kind"), F.col("b").alias("end"))
    reported = linked.where("kind in ('key40', 'secret')").select("key", "start", "kind", "end").unionByName(endpoints.select("key", "start", "kind", "end")).unionByName(named)
    return reported.groupBy("key").agg(F.array_sort(F.collect_set(F.struct("start", "kind", "end"))).alias("linked"))


def mark_spans(docs: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """keys, base, and, for texts with an identifier, key and weak: their candidates. One pass over the texts."""
    text = F.coalesce(docs[text_col], F.lit(""))
    base = F.concat(_spans(text, "assign", ASSIGN, 2, 8), _spans(text, "access", ACCESS), _spans(text, "hex", HEX))
    scoped = text.rlike(f"{ACCESS}|{IDENT}")
    weak = F.when(scoped, F.concat(_spans(text, "ident", IDENT), _spans(text, "key40", KEY40), _spans(text, "secret", SECRET), _spans(text, "endpoint", ENDPOINT)))
    # The digest keeps texts apart where ids repeat; equal rows share one link.
    key = F.concat_ws(":", *[F.coalesce(docs[k].cast("string"), F.lit("null")) for k in keys], F.md5(text))
    return docs.select(*keys, base.alias("base"), F.when(scoped, key).alias("key"), weak.alias("weak"))


def find_secrets(docs: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """keys, base and linked: arrays of (start, kind, end) of every row; code points, end exclusive."""
    kept = [f"__kept{i}" for i in range(len(keys))]
    renamed = docs.select(*[docs[k].alias(n) for k, n in zip(keys, kept, strict=True)], docs[text_col].alias("__text"))
    found = cut(mark_spans(renamed, kept, "__text"), "spans")
    back = [F.col(n).alias(k) for k, n in zip(keys, kept, strict=True)]
    none = F.array().cast(f"array<{SPAN}>")
    candidates = found.where("size(weak) > 0")
    # Texts without a weak candidate have nothing to link and need no join.
    others = found.where("not coalesce(size(weak) > 0, false)").select(*back, "base", none.alias("linked"))
    joined = candidates.join(_links(candidates).withColumnRenamed("key", "link_key"), F.col("key") == F.col("link_key"), "left")
    return others.unionByName(joined.select(*back, "base", F.coalesce("linked", none).alias("linked")))


def span_order(spans: Column, kinds: tuple[str, ...]) -> Column:
    """The spans by start, then kind in the order of kinds."""
    place = lambda s: F.array_position(F.array(*[F.lit(k) for k in kinds]), s["kind"])
    keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), place(s).alias("place"), s["kind"].alias("kind"), s["end"].alias("end")))
    return F.array_sort(keyed)
