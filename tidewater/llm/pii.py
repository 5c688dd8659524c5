"""Personal data by weak supervision: labelers, their reliabilities, a classifier.

Candidates are spans of four base kinds (email, ip, card, phone; regular
expressions over the whole text, leftmost and without overlap) and of two added
kinds: ``secret`` (a quoted or bare run of 20 to 128 letters and digits after a
key word such as ``token =``) and ``name`` (capitalised words after a form of
address).  On each candidate labelers vote 1, 0 or not at all:

* the kind's own check (parts of an address at most 255, 13 to 19 digits that
  pass the Luhn sum, 9 to 15 digits, a domain that ends in letters);
* a gazetteer (top-level domains, reserved networks, card prefixes, area codes);
* the context: words before the span that introduce such data or other numbers;
* the shape of the span, and whether it stands alone.

Expectation-maximisation over the counts of vote patterns (a table bounded by
kinds times patterns, whatever the corpus) estimates per kind the share of true
spans and every labeler's rates under conditional independence.  Its posteriors
are the soft labels on which a logistic classifier per kind is trained, over
features that no labeler votes on: the span's length and its shares of digits and
capital letters, in a few steps each.  Its training table, the counts of votes and
features, is bounded as well.  Added spans whose probability, from votes and
classifier together, is ``THRESHOLD`` or more are accepted.  Base spans that pass their check always stay.

Only DataFrame functions are used.  Defined results: a null text is an empty
one; a span's offsets are code points, the end exclusive; rows are handled one
by one (equal texts under one id alike); other columns are ignored by ``spans``
and kept by ``mask``; an empty table gives an empty one.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewater.llm.common import id_text, settle

MARK, OTHER_MARK = "", ""        # cuts a text at its matches; not in any pattern
BASE = ("email", "ip", "card", "phone")
ADDED = ("secret", "name")
CONTEXT = 24                                  # code points before a span that labelers see
THRESHOLD, ROUNDS = 0.5, 25
STEPS = (10, 5, 5)                            # steps of a span's length (in powers of two) and of its shares of digits and capitals
RIDGE = 1.0

# Each pattern starts a run or where the last match ended, and takes whole runs,
# so that no text makes it try a run again from every place.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "secret": r"(?i)(?<=(?:token|secret|apikey|api_key|password|passwd|key)\x20?[=:]\x20?[\"']?)[A-Za-z0-9_-]{20,128}+",
    "name": r"(?<=\b(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau)\.?\x20)\p{Lu}\p{Ll}{1,30}+(?:\x20\p{Lu}\p{Ll}{1,30}+)?+",
}
# cheap tests that a text must pass to hold a match at all
NEEDS = {"email": r"@", "ip": r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]",
         "secret": r"(?i)(?:token|secret|key|passw)", "name": r"\b(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau)\b"}
# fixed word lists of the labelers
INTRODUCES = {"email": r"(?i)(?:mail|contact|write|reach)", "ip": r"(?i)(?:\bip\b|address|host|server|login)", "card": r"(?i)(?:card|visa|credit|payment|pay)",
              "phone": r"(?i)(?:phone|call|tel|mobile|fax|contact)", "secret": r"(?i)(?:token|secret|passw|api|key)", "name": r"(?i)(?:dear|contact|signed|by)"}
# given names, a fixed list
GIVEN = ("Adam Ahmed Alan Albert Alexander Alice Amelie Amir Ana Andrea Andreas Andrew Angela Anita Anna Anne Anthony Antonio Arthur Barbara Ben Bernd Betty Brian "
         "Carla Carlos Carmen Carol Caroline Charles Charlotte Chen Chloe Christian Christine Claire Claudia Clara Daniel David Deborah Diana Diego Dieter Donald "
         "Dorothy Edward Elena Elizabeth Emily Emma Eric Eva Fatima Felix Fernando Francisco Frank Franz Gabriel George Gerhard Giulia Grace Hannah Hans Heinz Helen "
         "Helga Henry Ingrid Isabel Ivan Jack Jacques James Jan Jane Javier Jean Jennifer Jessica Joan Johann John Jonas Jorge Jose Joseph Juan Julia Julie Karen Karl "
         "Katharina Kevin Klaus Laura Lena Leo Linda Lisa Louis Lucas Lucia Luis Lukas Luke Manuel Maria Marie Mark Markus Martin Mary Matthew Max Mehmet Michael "
         "Miguel Mohammed Monika Nancy Natalie Nicole Nina Nora Olga Oliver Olivia Omar Patricia Patrick Paul Pedro Peter Petra Philip Pierre Rachel Rebecca Renate "
         "Richard Robert Rosa Ruth Sabine Samuel Sandra Sara Sarah Sofia Sophie Stefan Stephen Steven Susan Sven Teresa Thomas Tim Tom Uwe Vera Victor Walter Wei "
         "William Wolfgang Yusuf").split()
# words that begin sentences, not names; a fixed list
NO_NAME = r"^(?:The|This|That|These|Those|And|But|When|With|From|Your|Our|Der|Die|Das|Les|Une|Los|Las)\b"
# generic top-level domains, a fixed list; countries have two letters
GENERIC = "com org net edu gov mil int info biz name pro aero coop museum io dev app online site shop blog cloud email".split()
DENIES = r"(?i)(?:version|section|isbn|chapter|page|figure|example)[^\n]{0,8}$"


def _pieces(kind: str):
    """Text between matches and matches in turn: odd places are matches."""
    safe = F.replace("text", F.lit(MARK), F.lit(OTHER_MARK))
    return F.split(F.regexp_replace(safe, "(" + PATTERNS[kind] + ")", MARK + "$1" + MARK), MARK)


def candidates(docs: DataFrame) -> DataFrame:
    """``(doc_id, th, kind, start, end, span, before)`` of all matches."""
    # a text is cut only for the kinds it can hold; the others cost one scan
    some = F.filter(F.array(*[F.when(F.col("text").rlike(NEEDS[k]), F.struct(F.lit(k).alias("kind"), _pieces(k).alias("p"))) for k in PATTERNS]),
                    lambda x: x.isNotNull() & (F.size(x["p"]) > 1))
    found = docs.select("doc_id", "th", F.explode_outer(some).alias("f")).filter("f IS NOT NULL")
    # kind and pieces as columns of their own: else each piece would carry all
    parts = found.select("doc_id", "th", "f.kind", "f.p").select("doc_id", "th", "kind", F.posexplode_outer("p").alias("at", "part"))
    parts = parts.select("doc_id", "th", "kind", "at", F.length("part").cast("bigint").alias("len"),
                         F.when(F.col("at") % 2 == 1, F.col("part")).alias("span"), F.when(F.col("at") % 2 == 0, F.right("part", F.lit(CONTEXT))).alias("tail"))
    # equal rows give equal parts; they are cut once
    parts = parts.dropDuplicates(["doc_id", "th", "kind", "at"])
    w = W.partitionBy("doc_id", "th", "kind").orderBy("at")
    done = parts.withColumn("end", F.sum("len").over(w)).withColumn("before", F.coalesce(F.lag("tail").over(w), F.lit("")))
    return done.filter("at % 2 = 1").select("doc_id", "th", "kind", (F.col("end") - F.col("len")).alias("start"), "end", "span", "before")


def checked(kind, span) -> F.Column:
    """The contract's test of a base match."""
    digits = F.regexp_replace(span, "[^0-9]", "")
    n = F.length(digits)
    luhn = F.aggregate(F.sequence(F.lit(1), F.greatest(F.least(n, F.lit(19)), F.lit(1))), F.lit(0), lambda s, i: s + _luhn(F.substr(digits, n - i + 1, F.lit(1)).try_cast("int"), i))
    small = F.forall(F.split(span, r"\."), lambda p: F.length(F.regexp_replace(p, "^0+", "")) <= 3) & F.forall(
        F.split(span, r"\."), lambda p: F.coalesce(F.right(p, F.lit(4)).try_cast("int"), F.lit(0)) <= 255)
    return (F.when(kind == "email", F.lit(True)).when(kind == "ip", small)
            .when(kind == "card", n.between(13, 19) & (luhn % 10 == 0)).when(kind == "phone", n.between(9, 15)).otherwise(F.lit(False)))


def _luhn(d, i) -> F.Column:
    twice = F.coalesce(d, F.lit(0)) * F.when(i % 2 == 0, 2).otherwise(1)
    return F.when(twice > 9, twice - 9).otherwise(twice)


def votes(c: DataFrame) -> DataFrame:
    """Adds ``base`` (passes the contract's test) and ``votes``: one sign for
    each labeler, 1, 0 or -."""
    kind, span, before = F.col("kind"), F.col("span"), F.col("before")
    c = c.withColumn("base", checked(kind, span))

    def sign(yes, no):
        return F.when(yes, "1").when(no, "0").otherwise("-")

    def by_kind(table: dict, otherwise):
        out = otherwise
        for k, v in table.items():
            out = F.when(kind == k, v).otherwise(out)
        return out

    own = F.when(kind.isin(*BASE), F.when(F.col("base"), "1").otherwise("0")).otherwise(
        sign(span.rlike("[0-9]") & span.rlike("[a-zA-Z]") | ((kind == "name") & span.rlike(r"\x20")),
             span.rlike("^(.)\\1+$") | ((kind == "name") & span.rlike(NO_NAME))))
    gazetteer = by_kind({
        "email": sign(span.rlike(r"(?i)\.(?:[a-z]{2}|" + "|".join(GENERIC) + ")$"), span.rlike(r"\.[0-9-]+$")),
        "ip": sign(span.rlike(r"^(?:[1-9]|[1-9][0-9]|1[0-9]{2}|2[01][0-9]|22[0-3])\."), span.rlike(r"^(?:0|127|255)\.")),
        "card": sign(span.rlike(r"^(?:4|5[1-5]|3[47]|6)"), span.rlike(r"^0")),
        "phone": sign(span.rlike(r"^\+(?:1|33|34|44|49)\b|^\+1"), span.rlike(r"^\+0")),
        "secret": sign(span.rlike(r"^(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64}|AKIA[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{36}|sk-[0-9A-Za-z-]{20,})$"), span.rlike(r"^[A-Za-z]+$")),
        "name": sign(span.rlike("^(?:" + "|".join(GIVEN) + r")\b"), span.rlike(NO_NAME)),
    }, F.lit("-"))
    context = F.when(before.rlike(DENIES), "0").when(by_kind({k: before.rlike(v) for k, v in INTRODUCES.items()}, F.lit(False)), "1").otherwise("-")
    shape = by_kind({
        "email": sign(F.length(span) <= 80, F.length(span) > 254), "ip": sign(F.length(span).between(7, 15), F.length(span) > 15),
        "card": sign(F.length(span) >= 13, F.length(span) < 12), "phone": sign(F.length(span).between(10, 22), F.length(span) > 30),
        "secret": sign(F.length(span) >= 24, F.length(span) < 22), "name": sign(F.length(span) >= 6, F.length(span) < 5)}, F.lit("-"))
    alone = sign(before.rlike(r"(?:^|[\s\"'(:=])$") | (before == ""), before.rlike(r"[A-Za-z0-9.]$"))
    return c.withColumn("votes", F.concat(own, gazetteer, context, shape, alone)).withColumn("traits", traits(span))


def traits(span) -> F.Column:
    """The span's features as one digit each."""
    n = F.greatest(F.length(span), F.lit(1))

    def share(pattern):
        return F.floor((n - F.length(F.regexp_replace(span, pattern, ""))) * (STEPS[1] - 1) / n)

    return F.concat(*[x.cast("int").cast("string") for x in (F.least(F.floor(F.log2(n)), F.lit(STEPS[0] - 1)), share("[0-9]"), share(r"\p{Lu}"))])


def reliabilities(voted: DataFrame) -> dict[str, dict[str, float]]:
    """Per kind, the posterior of each vote pattern by EM on pattern counts:
    at most 3 to the power of labelers rows for each kind."""
    rows = voted.groupBy("kind", "votes").agg(F.count(F.lit(1)).alias("n")).collect()
    out: dict[str, dict[str, float]] = {}
    for kind in {r.kind for r in rows}:
        table = sorted((r.votes, r.n) for r in rows if r.kind == kind)
        m = len(table[0][0])
        # start from the majority of votes
        post = [min(0.95, max(0.05, (v.count("1") + 1) / (v.count("1") + v.count("0") + 2))) for v, _ in table]
        for _ in range(ROUNDS):
            total = sum(n for _, n in table)
            share = min(0.99, max(0.01, sum(p * n for p, (_, n) in zip(post, table)) / total))
            rate = []
            for j in range(m):
                # smoothed rates of a vote of 1 among the votes cast, given true and false
                t1 = sum(p * n for p, (v, n) in zip(post, table) if v[j] == "1")
                t0 = sum(p * n for p, (v, n) in zip(post, table) if v[j] == "0")
                f1 = sum((1 - p) * n for p, (v, n) in zip(post, table) if v[j] == "1")
                f0 = sum((1 - p) * n for p, (v, n) in zip(post, table) if v[j] == "0")
                rate.append(((t1 + 4) / (t1 + t0 + 5), (f1 + 1) / (f1 + f0 + 5)))
            # the posterior: a sum of log-odds weights over the votes cast
            post = []
            for v, _ in table:
                z = math.log(share / (1 - share))
                for j, (a, b) in enumerate(rate):
                    z += math.log(a / b) if v[j] == "1" else math.log((1 - a) / (1 - b)) if v[j] == "0" else 0.0
                post.append(1 / (1 + math.exp(-max(-50.0, min(50.0, z)))))
        out[kind] = {v: p for (v, _), p in zip(table, post)}
    return out


def _design(marks: str) -> np.ndarray:
    """One row: 1, and one column a step of each feature."""
    return np.array([1.0, *(float(int(mark) == k) for n, mark in zip(STEPS, marks) for k in range(n))])


def classifier(voted: DataFrame, posterior: dict[str, dict[str, float]]) -> dict[str, tuple[np.ndarray, float]]:
    """Per kind, weights of a logistic model of the span's features, and the
    logit of the share of true spans.  Each row of the table of counts is a
    true span with its posterior's weight and a false one with the rest; Newton
    steps with a ridge penalty."""
    rows = voted.groupBy("kind", "votes", "traits").agg(F.count(F.lit(1)).alias("n")).collect()
    out = {}
    for kind, post in posterior.items():
        table = sorted((r.votes, r.traits, r.n) for r in rows if r.kind == kind)
        x = np.array([_design(t) for _, t, _ in table])
        n, y = np.array([float(t[2]) for t in table]), np.array([post[t[0]] for t in table])
        w, keep = np.zeros(x.shape[1]), np.r_[1e-6, np.full(x.shape[1] - 1, RIDGE)]
        for _ in range(ROUNDS):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            slope = x.T @ (n * (y - p)) - keep * w
            step = np.linalg.solve((x * (n * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ x + np.diag(keep), slope)
            w = w + np.clip(step, -4, 4)
            if np.abs(step).max() < 1e-9:
                break
        out[kind] = (w, float(_logit(n @ y / n.sum())))
    return out


def _logit(p):
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def score(model: tuple[np.ndarray, float], posterior: dict[str, float]) -> F.Column:
    """The probability of a row with ``votes`` and ``traits``: the evidence of the
    votes (their posterior) and of the features (the classifier), taken as
    independent given the truth, so the share of true spans counts once."""
    w, share = model
    votes = F.create_map(*[F.lit(x) for v, p in posterior.items() for x in (v, float(_logit(p)))])      # at most 243 patterns
    z, at = F.coalesce(votes[F.col("votes")], F.lit(share)) + F.lit(float(w[0]) - share), 1
    for j, n in enumerate(STEPS):
        z = z + F.element_at(F.array(*[F.lit(float(v)) for v in w[at:at + n]]), F.substr(F.col("traits"), F.lit(j + 1), F.lit(1)).cast("int") + 1)
        at += n
    return 1 / (1 + F.exp(-z))


def detect(docs: DataFrame) -> DataFrame:
    """``(doc_id, th, kind, start, end, base)`` of the accepted spans."""
    voted = settle(votes(candidates(docs)).drop("span", "before"))
    posterior = reliabilities(voted)
    models = classifier(voted, posterior)
    ok = F.col("base")
    for k in ADDED:
        if k in models:
            ok = ok | ((F.col("kind") == k) & (score(models[k], posterior[k]) >= THRESHOLD))
    return voted.filter(ok).select("doc_id", "th", "kind", "start", "end", "base")


def _listed(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    d = id_text(docs, id_col, text_col).withColumn("th", F.xxhash64("text"))
    order = F.array(*[F.lit(k) for k in BASE + ADDED])
    s = detect(d).groupBy("doc_id", "th").agg(F.array_sort(F.collect_list(
        F.struct(F.array_position(order, F.col("kind")).alias("k"), "start", "end", "kind", "base"))).alias("spans"))
    return d, s.select(F.col("doc_id").alias("__id"), F.col("th").alias("__th"), "spans")


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, spans)`` of every row: sorted structs ``(k, start, end,
    kind, base)``, an empty list without any."""
    d, s = _listed(docs, id_col, text_col)
    none = F.array().cast(s.schema["spans"].dataType)
    return (d.select("doc_id", "th").join(s, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("th") == F.col("__th")), "left")
            .select("doc_id", F.coalesce("spans", none).alias("spans")))


def mask(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with every accepted span replaced by ``<KIND>``;
    overlapping spans are replaced once, under the first one's kind."""
    _, s = _listed(docs, id_col, text_col)
    th = F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    j = docs.join(s, F.col(id_col).eqNullSafe(F.col("__id")) & (th == F.col("__th")), "left")
    by_place = F.array_sort(F.transform("spans", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"))))
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("bigint").alias("at"))
    text = F.col(text_col)
    done = F.aggregate(by_place, start, lambda a, x: F.when(x["start"] >= a["at"], F.struct(
        F.concat(a["out"], F.substr(text, (a["at"] + 1).cast("int"), (x["start"] - a["at"]).cast("int")), F.lit("<"), F.upper(x["kind"]), F.lit(">")).alias("out"),
        x["end"].alias("at"))).otherwise(F.struct(a["out"].alias("out"), F.greatest(a["at"], x["end"]).alias("at"))),
        lambda a: F.concat(a["out"], F.substr(text, (a["at"] + 1).cast("int"))))
    return j.select(*[F.when(F.col("spans").isNull(), text).otherwise(done).alias(c) if c == text_col else F.col(c) for c in docs.columns])


def _is(kind: str):
    return lambda s: s["kind"] == kind


def digests(found: DataFrame) -> DataFrame:
    base = F.filter("spans", lambda s: s["base"])
    line = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))      # noqa: E731
    return found.select("doc_id", *[F.size(F.filter(base, _is(k))).cast("bigint").alias(f"n_{k}") for k in BASE],
                        F.sha2(F.array_join(F.transform(base, line), ","), 256).alias("base_sha256"),
                        F.array_join(F.transform("spans", line), ",").alias("spans"))
