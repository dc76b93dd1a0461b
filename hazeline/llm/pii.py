"""Personal data by weak supervision (operator 10), DataFrame functions only.

1. Candidate spans: the four base kinds by their fixed forms, and wider ones (secrets, social security numbers, IBANs,
   spelled-out addresses).
2. Four labelers vote on every span: form, gazetteer, context and border, each with yes, no or no vote.
3. Votes are counted over all documents by kind: at most kinds * 3^4 rows, which bounds what comes to the driver.
   Expectation-maximisation over that table estimates each labeler's reliability and the share of true spans by kind.
4. A logistic span classifier is fitted to the expected labels of the table and applied as a column expression. Base
   spans always stay; the other candidates stay if the classifier accepts them and they overlap no base span.

Positions are code points, the end exclusive. They come from the lengths of what is between and in the matches, summed
by doubling steps. Forms use possessive repetition and look-behind, so that no text, however long or odd, takes more
than linear time.

Defined results: null and empty texts have no spans and the digest of the empty string. Repeated rows get equal
results. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from hazeline.llm.names import unused
from hazeline.session import materialized

KINDS = ("email", "ip", "card", "phone", "secret", "ssn", "iban", "address")
BASE_KINDS = 4
ROUNDS = 40
NEAR = 32
CHUNK = 512  # code points; no less than NEAR

EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
SECRET = r"(?i)(?:token|secret|password|passwd|api[_-]?key|access[_-]?key)\x20?[=:]\x20?[\x22\x27]?[A-Za-z0-9_/+=.-]{12,}+"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
ADDRESS = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?[\[(]at[\])]\x20?[A-Za-z0-9-]++(?:(?:\.|\x20?[\[(]dot[\])]\x20?)[A-Za-z0-9-]++)++"
FORMS = (EMAIL, IP, CARD, PHONE, SECRET, SSN, IBAN, ADDRESS)
# a cheap test that a text may hold the kind at all
HINTS = ("@", None, None, "+", None, "-", None, "at")

# Top-level domains, calling codes and words that announce a kind.
DOMAINS = r"(?i)\.(?:com|org|net|edu|gov|info|io|eu|de|fr|es|uk|it|nl|at|ch|be|pt|pl|ru|br|mx|jp|cn|in|us|ca|au|example|test)$"
CALLING_CODES = r"^\+(?:1|7|2[07]|3[0-46-9]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|2[1-69][0-9]|3[578][0-9]|42[013]|5[09][0-9]|6[7-9][0-9]|8[05789][0-9]|9[679][0-9])"
CUES = ("mail|contact|write", "ip|host|server|address|addr", "card|visa|credit|pay|karte|carte|tarjeta",
        "tel|phone|call|fon|mobil|fax", "key|auth|login|config|secret", "ssn|social|security", "iban|bank|konto|account",
        "mail|contact|write")
BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"


def _bound(value: Column, use) -> Column:
    return F.transform(F.array(value), use)[0]


def _running(values: Column, join) -> Column:
    """Each value of an array joined with all before it, in about log2(n) passes; ``join`` is associative, 0 changes nothing."""
    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(F.size(values), F.lit(1)))).cast("int"))
    return F.aggregate(steps, values, lambda s, k: F.transform(
        s, lambda x, i: join(x, F.coalesce(F.get(s, i - F.expr("1") * F.pow(F.lit(2), k).cast("int")), F.lit(0)))))


def _sums(values: Column) -> Column:
    return _running(values, lambda x, y: x + y)


def _part(chunks: Column, start: Column, length: Column) -> Column:
    """At most CHUNK code points of a text from its chunks, without counting from the text's start."""
    at = (start / CHUNK).cast("int")
    two = F.concat(F.coalesce(F.get(chunks, at), F.lit("")), F.coalesce(F.get(chunks, at + 1), F.lit("")))
    return F.substring(two, start - at * CHUNK + 1, length)


def _valid(kind: int, hit: Column) -> Column:
    digits = F.regexp_replace(hit, "[^0-9]", "")
    if KINDS[kind] == "ip":
        return hit.rlike(rf"^{BYTE}\.{BYTE}\.{BYTE}\.{BYTE}$")
    if KINDS[kind] == "phone":
        return F.length(digits).between(9, 15)
    if KINDS[kind] == "card":
        def luhn(d: Column) -> Column:
            def add(total: Column, i: Column) -> Column:
                x = F.substring(d, F.length(d) - i, F.lit(1)).cast("int")
                twice = F.when(x > 4, 2 * x - 9).otherwise(2 * x)
                return total + F.when(i % 2 == 1, twice).otherwise(x)
            whole = F.aggregate(F.sequence(F.lit(0), F.length(d) - 1), F.lit(0), add)
            return F.when(F.length(d).between(12, 19), whole % 10 == 0).otherwise(False)
        return _bound(digits, luhn)
    return F.lit(True)


def _matches(kind: int) -> Column:
    """start, end, kind and hit of the leftmost non-overlapping matches of a kind in ``text`` that are valid."""
    form, text = FORMS[kind], F.col("text")
    none = F.expr("cast(array() as array<struct<start:int,end:int,kind:int,hit:string>>)")
    hits = F.regexp_extract_all(text, F.lit(form), F.lit(0))
    gaps = F.split(text, form)

    def placed(hits: Column) -> Column:
        lengths = F.zip_with(hits, F.slice(F.transform(gaps, lambda g: F.char_length(g)), 1, F.size(hits)),
                             lambda h, g: F.char_length(h) + g)
        ends = _bound(lengths, _sums)
        spans = F.zip_with(hits, ends, lambda h, e: F.struct(
            (e - F.char_length(h)).alias("start"), e.alias("end"), F.lit(kind).alias("kind"), h.alias("hit")))
        return F.filter(spans, lambda s: _valid(kind, s["hit"]))

    maybe = text.rlike(form) if HINTS[kind] is None else (F.instr(text, HINTS[kind]) > 0) & text.rlike(form)
    return F.when(maybe, _bound(hits, placed)).otherwise(none)


def _by_kind(kind: Column, values: list[Column]) -> Column:
    out = F.lit(-1)
    for k, value in enumerate(values):
        out = F.when(kind == k, value).otherwise(out)
    return out


def _votes(s: Column, before: Column, after: Column) -> list[Column]:
    """Form, gazetteer, context and border: 1 yes, 0 no, -1 no vote."""
    hit, kind, none = s["hit"], s["kind"], F.lit(-1)
    mixed = (hit.rlike("[0-9]") & hit.rlike("[A-Za-z]")).cast("int")
    form = _by_kind(kind, [F.lit(1)] * BASE_KINDS + [mixed, (~hit.rlike("^(?:000|666|9)")).cast("int"), none, none])
    listed = _by_kind(kind, [
        hit.rlike(DOMAINS).cast("int"), (~hit.rlike(r"^(?:0|127|255)\.")).cast("int"), hit.rlike("^[3-6]").cast("int"),
        hit.rlike(CALLING_CODES).cast("int"), none, none, hit.rlike("^(?:DE|FR|ES|GB|IT|NL|AT|CH|BE|PT|PL)").cast("int"), none])
    context = _by_kind(kind, [F.when(before.rlike(f"(?i)(?:{cue})"), 1).otherwise(-1) for cue in CUES])
    border = F.when(F.right(before, F.lit(1)).rlike(r"[\p{L}\p{N}_]") | after.rlike(r"^[\p{L}\p{N}_]"), 0).otherwise(1)
    return [form.cast("int"), listed.cast("int"), context.cast("int"), border.cast("int")]


LABELERS = ("form", "listed", "context", "border")


def candidates(docs: DataFrame) -> DataFrame:
    """docs with ``text`` filled and ``found``: candidate spans with their votes, by start and kind."""
    filled = docs.withColumn("text", F.coalesce("text", F.lit("")))
    spans = F.concat(*[_matches(k) for k in range(len(KINDS))])

    def voted(s: Column, chunks: Column) -> Column:
        before = _part(chunks, F.greatest(s["start"] - NEAR, F.lit(0)), F.least(s["start"], F.lit(NEAR)))
        after = _part(chunks, s["end"], F.lit(1))
        return F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"),
                        *[v.alias(n) for n, v in zip(LABELERS, _votes(s, before, after))])

    def judged(spans: Column) -> Column:
        chunks = F.when(F.size(spans) > 0, F.regexp_extract_all("text", F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0)))
        return _bound(chunks, lambda c: F.transform(spans, lambda s: voted(s, c)))
    return filled.withColumn("found", F.sort_array(_bound(spans, judged)))


class Classifier(NamedTuple):
    """Intercept by kind and a weight by labeler and vote (no, yes)."""

    intercepts: list[float]
    weights: list[tuple[float, float]]

    def accepts(self, s: Column) -> Column:
        score = _by_kind(s["kind"], [F.lit(float(x)) for x in self.intercepts])
        for name, (no, yes) in zip(LABELERS, self.weights):
            score = score + F.when(s[name] == 0, F.lit(no)).when(s[name] == 1, F.lit(yes)).otherwise(0.0)
        return score >= 0


def _expected(rows: list[tuple], rounds: int = ROUNDS) -> list[float]:
    """Probability that a span is true for each (kind, votes, count) row, by expectation-maximisation."""
    right = [0.8] * len(LABELERS)
    wrong = [0.3] * len(LABELERS)
    prior = [0.7] * len(KINDS)
    labels = [0.5] * len(rows)
    for _ in range(rounds):
        for r, (kind, votes, _) in enumerate(rows):
            yes, no = math.log(prior[kind]), math.log(1 - prior[kind])
            for j, v in enumerate(votes):
                if v >= 0:
                    yes += math.log(right[j] if v else 1 - right[j])
                    no += math.log(wrong[j] if v else 1 - wrong[j])
            labels[r] = 1 / (1 + math.exp(min(50.0, max(-50.0, no - yes))))
        for j in range(len(LABELERS)):
            sums = [[1.0, 2.0], [1.0, 2.0]]
            for p, (_, votes, n) in zip(labels, rows):
                if votes[j] >= 0:
                    for side, q in enumerate((p, 1 - p)):
                        sums[side][0] += n * q * votes[j]
                        sums[side][1] += n * q
            right[j], wrong[j] = max(0.51, sums[0][0] / sums[0][1]), min(0.49, sums[1][0] / sums[1][1])
        for k in range(len(KINDS)):
            mine = [(p, n) for p, (kind, _, n) in zip(labels, rows) if kind == k]
            prior[k] = (sum(p * n for p, n in mine) + 1) / (sum(n for _, n in mine) + 2)
    return labels


def fitted(rows: list[tuple]) -> Classifier:
    """The logistic classifier of the expected labels of (kind, votes, count) rows."""
    labels = _expected(rows)
    intercepts, weights = [0.0] * len(KINDS), [[0.0, 0.0] for _ in LABELERS]
    total = sum(n for _, _, n in rows) or 1
    for _ in range(400):
        by_kind, by_vote = [0.0] * len(KINDS), [[0.0, 0.0] for _ in LABELERS]
        for p, (kind, votes, n) in zip(labels, rows):
            score = intercepts[kind] + sum(weights[j][v] for j, v in enumerate(votes) if v >= 0)
            gap = (p - 1 / (1 + math.exp(min(50.0, max(-50.0, -score))))) * n / total
            by_kind[kind] += gap
            for j, v in enumerate(votes):
                if v >= 0:
                    by_vote[j][v] += gap
        intercepts = [w + 2 * (g - 1e-4 * w) for w, g in zip(intercepts, by_kind)]
        weights = [[w + 2 * (g - 1e-4 * w) for w, g in zip(*pair)] for pair in zip(weights, by_vote)]
    return Classifier(intercepts, [tuple(w) for w in weights])


def learned(found: DataFrame) -> Classifier:
    """The span classifier of a frame of candidates."""
    votes = found.select(F.explode("found").alias("s")).groupBy("s.kind", *[f"s.{n}" for n in LABELERS]).count()
    rows = [(r["kind"], tuple(r[n] for n in LABELERS), r["count"]) for r in votes.collect()]
    return fitted(sorted(rows))


def _kept(classifier: Classifier) -> Column:
    """Base spans and the accepted others that overlap none of them."""
    base = F.filter("found", lambda s: s["kind"] < BASE_KINDS)
    more = F.filter("found", lambda s: (s["kind"] >= BASE_KINDS) & classifier.accepts(s))

    def mark(place: Column, order: int, end: Column, s: Column) -> Column:
        return F.struct(place.alias("place"), F.lit(order).alias("order"), end.alias("end"), s.alias("span"))

    # in order of base starts and other ends, a span is free if no base span that starts before its end ends after its start
    marks = F.sort_array(F.concat(F.transform(base, lambda s: mark(s["start"], 1, s["end"], s)),
                                  F.transform(more, lambda s: mark(s["end"], 0, F.lit(0), s))))

    def unmet(marks: Column) -> Column:
        reach = _running(F.transform(marks, lambda m: m["end"]), F.greatest)
        both = F.arrays_zip(marks.alias("marks"), reach.alias("reach"))
        free = F.filter(both, lambda x: (x["marks"]["order"] == 1) | (x["reach"] <= x["marks"]["span"]["start"]))
        return F.sort_array(F.transform(free, lambda x: x["marks"]["span"]))
    return F.when(F.size(more) == 0, base).otherwise(_bound(marks, unmet))


def _written(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, base_sha256 and spans for each row of docs (doc_id, text)."""
    found = materialized(candidates(docs.select("doc_id", "text")).select("doc_id", "found"), "spans")
    kept = found.select("doc_id", _kept(learned(found)).alias("kept"))

    def count(k: int) -> Column:
        return F.size(F.filter("kept", lambda s: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")

    base = F.filter("kept", lambda s: s["kind"] < BASE_KINDS)
    return kept.select("doc_id", *map(count, range(BASE_KINDS)), F.sha2(_written(base), 256).alias("base_sha256"), _written(F.col("kept")).alias("spans"))


def redacted(docs: DataFrame) -> DataFrame:
    """docs with every span replaced by its kind in brackets and n_chars counted anew; null texts stay null."""
    blank, kept_name, new, found_name = unused([*docs.columns, "found"], "__null", "__kept", "__new", "__found")
    classifier = learned(candidates(docs.select("text")))
    own = docs.withColumnRenamed("found", found_name) if "found" in docs.columns else docs
    kept = candidates(own.withColumn(blank, F.col("text").isNull())).withColumn(kept_name, _kept(classifier)).drop("found")
    if "found" in docs.columns:
        kept = kept.withColumnRenamed(found_name, "found")

    def merged(spans: Column) -> Column:
        start = F.expr("cast(array() as array<struct<start:int,end:int,kind:int>>)")

        def add(done: Column, s: Column) -> Column:
            last = F.get(done, F.size(done) - 1)
            longer = F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"), last["kind"].alias("kind"))
            return F.when((F.size(done) > 0) & (s["start"] < last["end"]),
                          F.concat(F.slice(done, 1, F.size(done) - 1), F.array(longer))).otherwise(
                F.concat(done, F.array(F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))))
        return F.aggregate(spans, start, add)

    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])

    def rewritten(spans: Column) -> Column:
        pieces = F.transform(spans, lambda s, i: F.concat(F.substring(
            F.col("text"), F.coalesce(F.get(spans, i - 1)["end"], F.lit(0)) + 1,
            s["start"] - F.coalesce(F.get(spans, i - 1)["end"], F.lit(0))), F.get(names, s["kind"])))
        last = F.get(spans, F.size(spans) - 1)["end"]
        return F.concat(F.array_join(pieces, ""), F.substring(F.col("text"), last + 1, F.char_length("text") - last))

    text = F.when(F.col(blank), None).when(F.size(kept_name) == 0, F.col("text")).otherwise(
        _bound(merged(F.col(kept_name)), rewritten))
    out = kept.withColumn(new, text)
    changes = {"text": F.col(new)}
    if "n_chars" in docs.columns:
        changes["n_chars"] = F.when(F.size(kept_name) == 0, F.col("n_chars")).otherwise(
            F.char_length(new).cast(docs.schema["n_chars"].dataType))
    return out.withColumns(changes).select(docs.columns)
