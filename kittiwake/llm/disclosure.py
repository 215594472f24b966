"""Personal information inside free text.

Grammars propose spans; what a span discloses is estimated from the corpus: every word is counted in the free text and in
the protected fields (name, email, street, city), and the logarithm of the two rates says how strongly the word reveals
the field. Number forms are weighed by how often words that name a protected number stand before them. A span whose terms
stay below the threshold is still taken where the words before such spans mostly introduce disclosing ones. Spans above
the threshold are replaced by typed placeholders, the rest of the text is untouched.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kittiwake.llm.addresses import STREET_TYPES
from kittiwake.llm.gazetteer import words
from kittiwake.runtime import cut

PLACEHOLDERS = {"email": "[EMAIL]", "phone": "[PHONE]", "idno": "[ID]", "address": "[ADDRESS]", "person": "[PERSON]"}
# Words that name a protected number.
LABELS = {
    "phone": ("phone", "call", "ring", "text", "tel", "telephone", "mobile", "cell", "fax", "dial", "sms", "duty", "hotline"),
    "idno": ("passport", "id", "identity", "national", "tax", "personal", "ssn", "licence", "license", "badge"),
}
#: Earlier kinds win where spans overlap.
PRIORITY = ("email", "address", "idno", "phone", "person")

_LOCAL = r"[^\W_](?:[\w.+\-]*[^\W_])?"
_LABEL = r"[^\W_](?:[\w\-]*[^\W_])?"
_SPELLED_DOT = r"(?:\s*[\[(]\s*dot\s*[\])]\s*|\s+dot\s+)"
_EMAIL = re.compile(rf"(?<![\w.+\-]){_LOCAL}(?:(?:\s?@\s?|\s*[\[(]\s*at\s*[\])]\s*){_LABEL}(?:(?:\.|{_SPELLED_DOT}){_LABEL})+|\s+at\s+{_LABEL}(?:{_SPELLED_DOT}{_LABEL})+)(?!\w)", re.I)
_AT = re.compile(r"@|[\[(]\s*at\s*[\])]|\sat\s+\S+\s+dot\s", re.I)
_NUMBER = re.compile(
    r"(?<![\w@.+\-/])(?<![0-9]:)(?:(?!ID )[A-Z]{1,2} ?)?(?:\+|\()?[0-9](?:[0-9]|[ .\-](?=[0-9(])|\)[ .\-]?(?=[0-9])|[ .\-]?\((?=[0-9]))*[0-9](?:[A-Z](?![\w]))?"
    r"(?:,? ?(?:extension|ext|x)\.? ?[0-9]{1,6})?(?![\w@%:/])"
)
_TYPES = "|".join(sorted({f for forms in STREET_TYPES.values() for f in forms}, key=len, reverse=True))
_WORD = r"[^\W\d_](?:[^\W\d_]|['’\-](?=[^\W\d_]))*"
_HOUSE_FIRST = re.compile(rf"(?<![\w\-.,:/])[0-9]{{1,5}}[A-Za-z]? (?P<street>{_WORD}(?: {_WORD}){{0,2}}?) (?P<type>{_TYPES})\b\.?", re.I)
_HOUSE_LAST = re.compile(rf"(?<![\w\-])(?P<street>{_WORD}(?: {_WORD}){{0,2}}?) (?P<type>{_TYPES})\b\.? [0-9]{{1,5}}[A-Za-z]?(?![\w\-.]*[0-9])", re.I)
_TYPE_THEN_NUMBER = re.compile(rf" (?:{_TYPES})\b\.? [0-9]", re.I)
_NAMES = {(1, 1), (1, 2), (2, 1), (1, 2, 1)}
_ZIP = r"[0-9]{5}(?:-[0-9]{4})?"
_TOKEN = re.compile(_WORD)
_LETTERS = re.compile(r"[^\W\d_]+")

_SPAN = "id long, k binary, start int, stop int, kind string, found string, cue string, terms array<string>"


def _form(text: str) -> str:
    return "".join("9" if c.isdigit() else "A" if c.isalpha() else c for c in text)


def _cue(text: str, start: int) -> str:
    """The word before a span with what stands between, in lower case and without digits."""
    before = text[max(0, start - 40) : start].lower()
    m = re.search(r"([^\W\d_]+)?([^\w]*)$", before)
    return ((m[1] or "") + m[2].strip()) if m else ""


def _address_end(text: str, at: int, cities: frozenset[str], longest: int) -> tuple[int, bool]:
    """End of an address whose street part ends at ``at``, with zipcode and city in either order; whether one was found."""
    best, named = at, False
    m = re.match(rf",? ?(?P<zip>{_ZIP})(?![\w\-])", text[at:])
    pos = at + m.end() if m else at
    lead = re.match(r",? +" if not m else r" +", text[pos:])
    if m:
        best = pos
    if lead:
        start = pos + lead.end()
        tail, w = text[start:], list(_TOKEN.finditer(text[start : start + 160]))
        for n in range(min(longest, len(w)), 0, -1):
            if w[0].start() == 0 and all(tail[a.end() : b.start()] == " " for a, b in zip(w[: n - 1], w[1:n])) and "".join(words(tail[: w[n - 1].end()])) in cities:
                best, named = start + w[n - 1].end(), True
                if not m and (z := re.match(rf",? {_ZIP}(?![\w\-])", text[best:])):
                    best += z.end()
                break
    return (best, named or bool(m)) if (named or m) else (at, False)


def propose(text: str, common: frozenset[str], cities: frozenset[str], longest: int) -> list[tuple[int, int, str, list[str]]]:
    """(start, stop, kind, terms) of everything in a text that has the form of personal information."""
    spans: list[tuple[int, int, str, list[str]]] = []
    taken: list[tuple[int, int]] = []
    for m in _EMAIL.finditer(text) if _AT.search(text) else ():
        # the words of the local part and of the domain, without those that spell out signs
        spans.append((m.start(), m.end(), "email", [x for x in _LETTERS.findall(m.group().lower()) if x not in ("at", "dot")]))
        taken.append(m.span())
    free = lambda a, b: all(b <= x or a >= y for x, y in taken)
    for pattern in (_HOUSE_FIRST, _HOUSE_LAST):
        if pattern is _HOUSE_LAST and not _TYPE_THEN_NUMBER.search(text):
            continue
        for m in pattern.finditer(text):
            name = m["street"].split(" ")
            start = m.start()
            if pattern is _HOUSE_LAST:
                # the name may reach back into ordinary words
                while len(name) > 1 and (name[0].lower() in common or (name[-1][0].isupper() and any(x[0].islower() for x in name))):
                    start += len(name[0]) + 1
                    name = name[1:]
            if any(x.lower() in common for x in name):
                continue
            stop, placed = _address_end(text, m.end(), cities, longest)
            if stop == m.end() and text[stop - 1] == ".":
                stop -= 1
            if free(start, stop):
                spans.append((start, stop, "address", [m["type"].lower(), *(_LETTERS.findall(text[m.end() : stop].lower()) if placed else [])]))
                taken.append((start, stop))
    for m in _NUMBER.finditer(text):
        if sum(c.isdigit() for c in m.group()) >= 6 and free(*m.span()):
            spans.append((m.start(), m.end(), "number", [_form(m.group())]))
    # 0 for an ordinary word, 1 for a rare one, 2 for a letter on its own
    w, role, title = [], [], []
    for m in _TOKEN.finditer(text):
        x = m.group().lower()
        if len(x) == 1:
            r = 0 if text[m.end() : m.end() + 1].isalnum() else 2
        else:
            r = int(x not in common and (x.isalpha() or any(p not in common for p in _LETTERS.findall(x) if len(p) > 1)))
        w.append(m)
        open_ = not taken or free(*m.span())
        role.append(r if open_ else 0)
        # an ordinary word may still be part of what looks like a name, if all of it is written with capitals
        title.append(r or int(open_ and x[0] != m.group()[0]))
    for k in range(len(w) - 1):
        if not title[k] or not title[k + 1]:
            continue
        for n in (2, 3):
            roles = tuple(role[k : k + n])
            if 0 in roles and all(x.group()[0].isupper() for x in w[k : k + n]):
                roles = tuple(title[k : k + n])
            # given and family name, an initial and a name, or a middle initial between two names
            if len(roles) < n or roles not in _NAMES:
                continue
            run = w[k : k + n]
            gaps = [text[x.end() : y.start()] for x, y in zip(run, run[1:])]
            if not all(g in (" ", ", ") or (g == ". " and r == 2) for g, r in zip(gaps, roles)) or gaps.count(", ") > 1:
                continue
            if n == 2 and 2 in roles and text[run[roles.index(2)].end() : run[roles.index(2)].end() + 1] != ".":
                continue
            stop = run[-1].end() + (roles[-1] == 2)
            spans.append((run[0].start(), stop, "person", [p for x, r in zip(run, roles) if r == 1 for p in _LETTERS.findall(x.group().lower()) if len(p) > 1]))
    return spans


def _extract(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, cities, longest = shared.value
        for b in batches:
            out = []
            for i, k, text in zip(*(c.to_pylist() for c in b.columns)):
                for start, stop, kind, terms in propose(text, common, cities, longest):
                    cue = _cue(text, start)
                    if kind == "number":
                        # what stands before an earlier number belongs to that one
                        near = _LETTERS.findall(re.split("[0-9]", text[max(0, start - 30) : start].lower())[-1])[-3:]
                        cue = next((label for x in reversed(near) for label, known in LABELS.items() if x in known), "")
                    out.append((i, k, start, stop, kind, text[start:stop], cue, terms))
            cols = list(zip(*out)) or [()] * 8
            types = (pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["id", "k", "start", "stop", "kind", "found", "cue", "terms"])

    return run


def _apart(spans: list[dict]) -> list[dict]:
    """Of overlapping spans the first by kind, then the longer at the same start, then the leftmost."""
    kept: list[dict] = []
    for s in sorted(spans, key=lambda s: (PRIORITY.index(s["kind"]), s["start"], -s["stop"])):
        if all(s["stop"] <= x["start"] or s["start"] >= x["stop"] for x in kept):
            kept.append(s)
    return kept


def _resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = [(i, *(s[k] for k in ("start", "stop", "kind", "found"))) for i, spans in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for s in _apart(spans)]
        cols = list(zip(*out)) or [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string()))], names=["id", "start", "stop", "kind", "found"])


def word_counts(rows: DataFrame, fields: dict[str, str]) -> DataFrame:
    """word and n_<label> for every label: how often the word stands in that column, over all rows."""
    pieces = F.array(*[F.struct(F.lit(label).alias("f"), F.regexp_extract_all(F.lower(F.coalesce(rows[c], F.lit(""))), F.lit(r"(\p{L}+)"), F.lit(1)).alias("w")) for label, c in fields.items()])
    each = rows.select(F.explode(pieces).alias("p")).select(F.col("p.f").alias("f"), F.explode("p.w").alias("word"))
    return each.groupBy("word").agg(*[F.count(F.when(F.col("f") == label, 1)).alias(f"n_{label}") for label in fields])


def _decided(users: DataFrame, cities: DataFrame, *, id_column: str = "id", text: str = "description", name: str = "name", email: str = "email", street: str = "street", city: str = "city", city_name: str = "city_name", other_name: str = "alt_name", threshold_bits: float = 1.0, common_share: float = 1e-5, common_least: int = 20, cue_share: float = 0.2, name_cue_share: float = 0.5, cue_least: int = 5, form_share: float = 0.1, max_cities: int = 100_000) -> DataFrame:
    """(id, k, start, stop, kind, found): spans that disclose, which may still overlap; k is the digest of the text."""
    spark = users.sparkSession
    fields = {"text": text, "name": name, "email": email, "street": street, "city": city}
    counts = cut(word_counts(users, fields))
    total = counts.agg(*[F.sum(f"n_{k}").alias(k) for k in fields]).first()
    n = {k: float(total[k] or 1) for k in fields}
    # a term's co-occurrence with a protected field, against its rate in the text; one that the field never holds discloses
    # nothing, however short the field is
    bits = {k: F.when(F.col(f"n_{k}") > 0, F.log2((F.col(f"n_{k}") / n[k]) / ((F.col("n_text") + 0.5) / n["text"]))).otherwise(F.lit(-99.0)) for k in ("name", "email", "street", "city")}
    often = counts.where((F.col("n_text") >= max(common_least, common_share * n["text"])) & (bits["name"] < threshold_bits))
    common = frozenset(r[0] for r in often.select("word").collect())
    rows = cities.select(city_name, other_name).limit(max_cities + 1).collect()
    if len(rows) > max_cities:
        raise ValueError(f"more than {max_cities} cities")
    listed = [w for r in rows for w in r if w]
    longest = max((len(w.split()) for w in listed), default=1)
    shared = spark.sparkContext.broadcast((common, frozenset("".join(words(w)) for w in listed), longest))
    texts = users.where(users[text] != "").select(users[id_column].cast("long").alias("id"), _digest(users[text]).alias("k"), users[text].alias("text"))
    spans = cut(texts.mapInArrow(_extract(shared), _SPAN))

    numbers = spans.where(F.col("kind") == "number").withColumn("form", F.col("terms")[0])
    forms = numbers.groupBy("form").agg(F.count("*").alias("n"), *[F.count(F.when(F.col("cue") == k, 1)).alias(k) for k in LABELS])
    best = F.greatest(*LABELS)
    told = forms.where(best >= form_share * F.col("n")).select("form", F.when(F.col("idno") == best, "idno").otherwise("phone").alias("told"))
    # a label of its own decides; the form only tells numbers without one
    own = F.when(F.col("cue") != "", F.col("cue"))
    numbers = numbers.join(told, "form", "left").withColumn("kind", F.coalesce(own, "told")).where(F.col("kind").isNotNull()).select("id", "k", "start", "stop", "kind", "found")

    span = ["id", "k", "start", "stop", "kind", "found", "cue"]
    term = F.col("kind")
    score = F.when(term == "person", bits["name"]).when(term == "email", bits["email"]).otherwise(F.greatest(bits["street"], bits["city"]))
    scored = spans.where(F.col("kind") != "number").select(*span, F.explode_outer("terms").alias("word")).join(counts, "word", "left").withColumn("bits", score)
    # a word that the text holds often and that still discloses nothing is an ordinary one, and known to be
    usual = (F.col("n_text") >= common_least) & (bits["name"] < threshold_bits)
    scored = scored.groupBy(*span).agg(F.min(F.coalesce("bits", F.lit(-99.0))).alias("low"), F.max(F.coalesce("bits", F.lit(-99.0))).alias("high"), F.max(F.coalesce(usual, F.lit(False))).alias("usual"))
    scored = scored.withColumn("shown", F.when(term == "person", F.col("low")).otherwise(F.col("high")) >= threshold_bits)
    cues = scored.groupBy("kind", "cue").agg(F.count("*").alias("n"), F.count(F.when(F.col("shown"), 1)).alias("n_shown"))
    cues = cues.where((F.col("n") >= cue_least) & (F.col("n_shown") >= F.when(F.col("kind") == "person", name_cue_share).otherwise(cue_share) * F.col("n"))).select("kind", "cue", F.lit(True).alias("leads"))
    named = (term != "person") | (F.col("found").rlike(r"^\p{Lu}.*[ ,.]\p{Lu}") & ~F.col("usual"))
    worded = scored.join(cues, ["kind", "cue"], "left").where(F.col("shown") | (F.col("leads") & named)).select("id", "k", "start", "stop", "kind", "found")
    return numbers.unionByName(worded)


def _digest(text: Column) -> Column:
    return F.unhex(F.md5(text.cast("binary")))


def disclosing_spans(users: DataFrame, cities: DataFrame, **options) -> DataFrame:
    """(id, start, stop, kind, found): the spans of ``text`` that disclose personal information, not overlapping.

    kind is email, phone, idno, address or person; start and stop count characters. ``threshold_bits``: least logarithm
    of a term's rate in the protected field over its rate in the text: of all parts of a person's name, of any part of an
    email (local part or domain), of the type or place of an address. ``common_least``: so often a word must stand in the
    text to be known as ordinary. ``cue_share``, ``name_cue_share``: least share of disclosing spans after a word before
    others after it are taken too, names only if none of their words is known as ordinary. Rows without id or text have no
    span; each row of a repeated id is judged by its own text; texts are read whole; empty tables give no rows; other
    columns are not read. For the other options see ``_decided``.

    Counts cover all rows. Broadcast: words with at least ``common_share`` of all words in the text, hence at most
    1 / common_share of them, which lower-case names, streets and their ends are told by, and the names of ``cities``,
    refused beyond ``max_cities``.
    """
    spans = _decided(users, cities, **options).where(F.col("id").isNotNull())
    # equal rows have equal spans, so that a set is no larger than one text's
    by_text = spans.groupBy("id", "k").agg(F.collect_set(F.struct("start", "stop", "kind", "found")).alias("spans")).select("id", "spans")
    return by_text.mapInArrow(_resolve, "id long, start int, stop int, kind string, found string")


def sanitise(users: DataFrame, cities: DataFrame, *, id_column: str = "id", text: str = "description", **options) -> DataFrame:
    """(id, text): each text with its disclosing spans generalised to typed placeholders; see ``disclosing_spans``.

    Every row comes out, also those without id, by the spans of its own text. Texts without such spans, empty and null ones
    are as they were."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for t, spans in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                for s in sorted(_apart(spans or []), key=lambda s: -s["start"]):
                    t = t[: s["start"]] + PLACEHOLDERS[s["kind"]] + t[s["stop"] :]
                out.append(t)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], names=["id", "text"])

    spans = _decided(users, cities, id_column=id_column, text=text, **options).groupBy("k").agg(F.collect_set(F.struct("start", "stop", "kind", "found")).alias("spans"))
    own = users.select(users[id_column].cast("long").alias("id"), users[text].alias("text"), _digest(users[text]).alias("k"))
    return own.join(spans, "k", "left").select("id", "text", "spans").mapInArrow(run, "id long, text string")
