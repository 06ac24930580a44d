"""Personal data: exact base rules, and boosted trees over high-recall candidates.

Base rules find e-mail addresses, IP addresses, card and phone numbers by fixed patterns and
checks. On top, generous generators propose overlapping spans of the same kinds in looser forms
(other separators, no leading plus, written-out @ and dot). Boosted trees judge each proposal by
features of its format and of the text around it; probabilities are calibrated on examples the
trees have not seen, and per kind the threshold is the lowest one that keeps a set precision.
Accepted proposals that touch no base span and no better proposal are added.

No labels of personal data exist, so the trees learn from the corpus itself. Base spans are
positive, as they are and rewritten in looser forms in their own surroundings. Negative are
proposals of other forms than those, or in which the base rules' checks fail, and base spans broken
so that they fail. Proposals of the corpus in a looser form that pass the checks are not labelled:
they may be what the trees are to find. The
examples come from a bounded sample of documents: per kind at most ``sample`` that hold a base span
of it, by a hash of their id, and per document at most ``EXAMPLES_PER_TEXT`` examples, dealt in turn
over kinds, labels and forms. A kind with too few examples for a threshold of its own takes that of
all kinds. Everything else covers all rows, whole texts included; scans are linear in the text.
"""

from __future__ import annotations

import random
import re
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortmill.llm import boosting
from cohortmill.llm.common import stored

KINDS = ("email", "ip", "card", "phone")
SAMPLE = 4000
EXAMPLES_PER_TEXT = 40  # no less than the groups of ``labelled``, so that none is left out
LEAST_HELD = 20  # held-out positives of a kind for a threshold of its own
PRECISION = 0.99
AROUND = 24

Span = tuple[str, int, int]

# fixed values: the patterns of the base rules, written so that no start is tried twice
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# proposals, each with bounded runs
PROPOSALS = {
    "email": re.compile(r"(?<![\w.%+-])[\w.%+-]{1,64} ?(?:@|\(at\)|\[at\]|\{at\}| at ) ?[\w-]{1,63}"
                        r"(?: ?(?:\.|\(dot\)|\[dot\]| dot ) ?[\w-]{1,63}){1,5}", re.I),
    "ip": re.compile(r"(?<!\d)\d{1,4}(?:[.:,_-]|\[\.\]| \. )\d{1,4}(?:(?:[.:,_-]|\[\.\]| \. )\d{1,4}){2}(?!\d)"),
    "card": re.compile(r"(?<!\d)\d{3,6}(?:[\s./_ -]{0,2}\d{3,6}){2,4}(?!\d)"),
    "phone": re.compile(r"(?<!\d)(?:\+|00)?\(?\d{1,4}\)?(?:[\s./ -]{1,2}\(?\d{2,5}\)?){2,5}(?!\d)"),
}
# supersets of the patterns above and of the base rules: an e-mail proposal holds a mark, the others
# hold a run of at least six of the characters they are made of, from digit to digit
MARKED = re.compile(r"@|[(\[{ ]at[)\]} ]", re.I)
NUMERIC = re.compile(r"\d[\d\s()\[\]./_:, -]{4,}\d")
# looser forms, whole spans
AT = re.compile(r" ?(?:@|\(at\)|\[at\]|\{at\}) ?| at ", re.I)
DOT = re.compile(r" ?(?:\(dot\)|\[dot\]) ?| dot ", re.I)
ADDRESS = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOOSE = {
    "ip": re.compile(r"\d+(?:(?:\[\.\]\d+){3}|(?: \. \d+){3})"),
    "card": re.compile(r"\d{4}(?:(?:\.\d{4}){2,3}\.\d{1,4}|(?:/\d{4}){2,3}/\d{1,4}|(?:\s\d{4}){2,3}\s\d{1,4})"),
    "phone": re.compile(r"(?:(?:\+|00)?\d{1,5}[ .-])?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}"),
}
CUES = {
    "email": re.compile(r"mail|contact|write", re.I), "ip": re.compile(r"\bip\b|host|server|addr", re.I),
    "card": re.compile(r"card|visa|credit|iban|account", re.I),
    "phone": re.compile(r"tel|phone|call|fax|mobil", re.I)}
SECRET = re.compile(r"token|key|secret|hash|version|isbn|\bv\d", re.I)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def holds(kind: str, found: str) -> bool:
    """The check that a match of a base pattern must pass."""
    if kind == "ip":
        return all(map(octet, found.split(".")))
    digits = digits_of(found) if kind != "email" else ""
    if kind == "card":
        return 14 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 10 <= len(digits) <= 15


def emails(text: str) -> Iterator[tuple[int, int]]:
    """From each @ to the left over its local part and to the right over its domain."""
    free, at = 0, text.find("@")
    while at >= 0:
        domain = DOMAIN.match(text, at + 1)
        if domain:
            start = at
            while start > free and text[start - 1] in LOCAL:
                start -= 1
            if start < at:
                yield start, domain.end()
                free = domain.end()
        at = text.find("@", max(at + 1, free))


def base_matches(text: str) -> Iterator[tuple[str, int, int, bool]]:
    """(kind, start, end, whether it passes) of leftmost non-overlapping matches per kind."""
    for start, end in emails(text):
        yield "email", start, end, True
    for kind, pattern in (("ip", IP), ("card", CARD), ("phone", PHONE)):
        for m in pattern.finditer(text):
            yield kind, m.start(), m.end(), holds(kind, m.group())


def base_spans(text: str) -> list[Span]:
    return [m[:3] for m in base_matches(text) if m[3]]


def proposals(text: str) -> list[Span]:
    """Overlapping candidate spans of all kinds."""
    marked, numeric = MARKED.search(text), NUMERIC.search(text)
    if not marked and not numeric:
        return []
    found = {(k, s, e) for k, s, e, _ in base_matches(text) if e - s >= 7}
    for kind, pattern in PROPOSALS.items():
        if marked if kind == "email" else numeric:
            found.update((kind, m.start(), m.end()) for m in pattern.finditer(text))
    return sorted(found, key=lambda s: (s[1], s[2], s[0]))


def may_hold(kind: str, found: str) -> bool:
    """Whether a proposal has a looser form of its kind and passes the checks of the base rules."""
    if kind == "email":
        return bool(ADDRESS.fullmatch(DOT.sub(".", AT.sub("@", found, count=1))))
    return bool(LOOSE[kind].fullmatch(found)) and holds(kind, found.replace("[.]", ".").replace(" ", "") if kind == "ip" else found)


def kind_of(c: str) -> int:
    return 0 if not c or c.isspace() else 1 if c.isalpha() else 2 if c.isdigit() else 3


def features(text: str, span: Span) -> list[float]:
    """Format of the span and of its surroundings."""
    kind, start, end = span
    found = text[start:end]
    # numbers in names and domains say nothing of the form of an address
    numbers = [] if kind == "email" else re.findall(r"\d+", found)
    digits = "" if kind == "email" else digits_of(found)
    before, after = text[max(0, start - AROUND):start], text[end:end + AROUND]
    groups = [len(g) for g in numbers] or [0]
    other = [c for c in found if not c.isalnum()]
    return [
        KINDS.index(kind), len(found), len(digits), sum(c.isalpha() for c in found), len(groups),
        min(groups), max(groups), len(set(other)), sum(c.isspace() for c in found), found.count("."),
        found.count("-"), found.count("@"), float("(" in found), float(found.startswith("+")),
        float(len(digits) > 1 and luhn(digits)),
        float(max((int(g) if len(g) < 5 else 9999) for g in numbers or ["0"]) <= 255),
        float(bool(re.search(r"[(\[{ ]at[)\]} ]", found, re.I))),
        float(bool(re.search(r"[(\[ ]dot[)\] ]|\.", found, re.I))),
        kind_of(before[-1:]), kind_of(after[:1]), float(bool(CUES[kind].search(before))),
        float(bool(SECRET.search(before))), float('"' in before[-3:] or "=" in before[-4:]),
        sum(c.isdigit() for c in before), sum(c.isdigit() for c in after),
        sum(c in "%$#&*|" for c in before + after), float(len(set(digits)) < 3),
        float(bool(re.search(r"\.\s", found))),
    ]


# fixed values: endings of domains in made-up addresses
ENDINGS = ("com", "org", "net", "edu", "de", "fr", "it", "es", "co.uk", "io", "info", "gov", "com.br")


def made_up_address(found: str) -> tuple[str, str]:
    """A name and a domain of no corpus, chosen by a hash of the address, so that the trees learn the
    form of an address and not the names that the corpus happens to use."""
    drawn = random.Random(zlib.crc32(found.encode()))
    letters = "".join(c for c in map(chr, range(97, 123)) if c not in "aeiou")

    def word(longest: int) -> str:
        return "".join(drawn.choice(letters) + drawn.choice("aeiou") * (drawn.random() < 0.8)
                       for _ in range(drawn.randint(1, longest)))

    parts = [word(4) for _ in range(drawn.randint(1, 3))]
    if drawn.random() < 0.3:
        parts[0] = parts[0][0]
    name = drawn.choice([".", "_", "-", ""]).join(parts) + (str(drawn.randint(1, 2030)) if drawn.random() < 0.35 else "")
    domain = [word(4) + (str(drawn.randint(1, 99)) if drawn.random() < 0.15 else "") for _ in range(drawn.choice([1, 1, 1, 2]))]
    return (name.title() if drawn.random() < 0.2 else name), ".".join([*domain, drawn.choice(ENDINGS)])


def loosened(kind: str, found: str) -> list[str]:
    """A base span in looser forms that are still personal data."""
    if kind == "email":
        name, _, domain = found.partition("@")
        return [f"{name} (at) {domain}", f"{name}[at]{domain.replace('.', '[dot]')}", f"{name} at {domain.replace('.', ' dot ')}"]
    if kind == "ip":
        return [found.replace(".", "[.]"), found.replace(".", " . ")]
    digits = digits_of(found)
    if kind == "card":
        return [".".join(digits[i:i + 4] for i in range(0, len(digits), 4)),
                "/".join(digits[i:i + 4] for i in range(0, len(digits), 4)),
                " ".join(digits[i:i + 4] for i in range(0, len(digits), 4))]
    local = digits[-10:]
    return [f"({local[:3]}) {local[3:6]}-{local[6:]}", f"{local[:3]}.{local[3:6]}.{local[6:]}",
            f"00{digits[:-10] or '1'} {local[:3]} {local[3:6]} {local[6:]}"]


def broken(kind: str, found: str) -> list[str]:
    """A base span changed into something of its shape that is not personal data."""
    digits = digits_of(found)
    if kind == "email":
        name, _, domain = found.partition("@")
        first = domain.partition(".")[0]
        return [f"{name}@{domain.replace('.', ' ')} 1.2", f"{domain.replace('.', ' at ')} the. {name[:3]}",
                f"{name} at {first}. {name[:3].title()}"]
    if kind == "ip":
        # a part may have any number of leading zeros
        parts = [part.lstrip("0")[:3] or "0" for part in found.split(".")]
        return [".".join([parts[0], str(int(parts[1]) + 300), *parts[2:]]), "-".join(["2021", "11", "05", "0900"]),
                f"{parts[0]},{int(parts[1]) + 256},{parts[2]},{parts[3]}"]
    if kind == "card":
        wrong = digits[:-1] + str((int(digits[-1]) + 1) % 10)
        return [wrong, " ".join(wrong[i:i + 4] for i in range(0, len(wrong), 4)), wrong[:12], wrong[:9] + "." + wrong[9:13]]
    return [f"{digits[:2]} {digits[2:4]} {digits[4:6]}", f"{digits[:4]}-{digits[4:6]}-{digits[6:8]}",
            " ".join(digits[i:i + 3] for i in range(0, len(digits), 3)) + " " + digits * 2]


def labelled(text: str) -> Iterator[tuple[tuple[str, int, int], str, Span]]:
    """((kind, label, form), text, proposal): form 0 are the text's own proposals, 1 and up the
    rewritten base spans (per kind at most ``EXAMPLES_PER_TEXT`` of them, by hash; addresses with
    made-up names), each in a text of its own surroundings."""
    base = base_spans(text)
    known = set(base)
    found = proposals(text)
    for span in known.intersection(found):
        yield (span[0], 1, 0), text, span
    for span in _clear(found, base):
        if not may_hold(span[0], text[span[1]:span[2]]):
            yield (span[0], 0, 0), text, span
    chosen: dict[str, list] = {kind: [] for kind in KINDS}
    for kind, start, end in base:
        chosen[kind].append((zlib.crc32(f"{start} {text[start:end]}".encode("utf-8", "replace")), start, end))
    for kind, start, end in [(k, s, e) for k in KINDS for _, s, e in sorted(chosen[k])[:EXAMPLES_PER_TEXT]]:
        found = "@".join(made_up_address(text[start:end])) if kind == "email" else text[start:end]
        before, after = text[max(0, start - 60):start], text[end:end + 60]
        for forms, label in ((loosened(kind, found), 1), (broken(kind, found), 0)):
            for at, form in enumerate(forms, 1):
                changed = before + form + after
                inside = (len(before), len(before) + len(form))
                for span in proposals(changed):
                    whole = span[1] <= inside[0] and span[2] >= inside[1] and span[2] - span[1] <= len(form) + 2
                    if label and span[0] == kind and whole:
                        yield (kind, 1, at), changed, span
                    elif not label and span[1] < inside[1] and inside[0] < span[2] and not any(
                            b[1] < span[2] and span[1] < b[2] for b in base_spans(changed)):
                        yield (span[0], 0, at), changed, span
                    elif label and span[0] != kind and whole:
                        yield (span[0], 0, at), changed, span


def examples(text: str) -> list[tuple[list[float], int]]:
    """Labelled proposals of a text; at most ``EXAMPLES_PER_TEXT`` of them, dealt in turn over
    kind, label and form, and by hash within each."""
    groups: dict[tuple[str, int, int], list] = {}
    for at, (group, of, span) in enumerate(labelled(text)):
        own = groups.setdefault(group, [])
        own.append((zlib.crc32(f"{at} {of[span[1]:span[2]]}".encode("utf-8", "replace")), of, span))
        if len(own) >= 2 * EXAMPLES_PER_TEXT:
            own.sort()
            del own[EXAMPLES_PER_TEXT:]
    turns = sorted((turn, group, of, span) for group, own in groups.items()
                   for turn, (_, of, span) in enumerate(sorted(own)))
    return [(features(of, span), group[1]) for _, group, of, span in turns[:EXAMPLES_PER_TEXT]]


def sample_keys(hinted: DataFrame, sample: int) -> DataFrame:
    """Per kind the ``sample`` smallest keys of texts that hold a base span of it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            masks = [sum({1 << KINDS.index(s[0]) for s in base_spans(t.as_py())}) for t in batch.column("text")]
            held = pa.RecordBatch.from_arrays([batch.column("order"), pa.array(masks, pa.int32())], ["order", "kinds"])
            yield held.filter(pa.array([m > 0 for m in masks], pa.bool_()))

    held = stored(hinted.select("order", "text").mapInArrow(run, "order long, kinds int"), "pii_sample")
    keys = [held.where(F.col("kinds").bitwiseAND(1 << i) != 0).select("order").distinct().orderBy("order").limit(sample)
            for i in range(len(KINDS))]
    return keys[0].union(keys[1]).union(keys[2]).union(keys[3]).distinct()


def thresholds(p: np.ndarray, y: np.ndarray, kinds: np.ndarray, precision: float) -> dict[str, float]:
    """Per kind the lowest probability that keeps the precision. A kind with fewer than
    ``LEAST_HELD`` positives, or without such a probability, takes that of all kinds together; if
    there is none either, the highest probability of the examples. No kind is ever shut off."""
    pooled = boosting.threshold_for(p, y, precision)
    pooled = pooled if pooled <= 1 else float(p.max())
    limits = {}
    for i, kind in enumerate(KINDS):
        own = kinds == i
        limit = boosting.threshold_for(p[own], y[own], precision) if y[own].sum() >= LEAST_HELD else 2.0
        limits[kind] = max(0.5, limit if limit <= 1 else pooled)
    return limits


def fit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", sample: int = SAMPLE,
        precision: float = PRECISION) -> dict | None:
    """Trees, calibration and thresholds from at most ``sample`` texts per kind that hold base spans.

    Every fourth text is held out for calibration and thresholds; a sample too small for that is
    used whole for both. None, so that nothing is added, when it has no example of either label.
    """
    width = len(features("1", ("ip", 0, 1)))
    # any base span holds an @, or seven characters from digit to digit
    hinted = docs.select(F.col(doc_id).cast("string").alias("id"), F.col(text).alias("text")).where(
        F.col("text").rlike(r"@|[0-9][0-9 ().-]{5,}[0-9]")).select(
        F.xxhash64("id", "text").alias("order"), "text")
    # the sample is chosen by key alone, so texts that are not in it do not move
    chosen = hinted.join(F.broadcast(sample_keys(hinted, sample)), "order").dropDuplicates(["order"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for order, value in zip(batch.column("order").to_pylist(), batch.column("text")):
                found = examples(value.as_py())
                if found:
                    yield pa.RecordBatch.from_pydict({
                        "order": [order], "x": [np.array([f for f, _ in found], np.float32).tobytes()],
                        "y": [np.array([y for _, y in found], np.int8).tobytes()]})

    rows = chosen.mapInArrow(run, "order long, x binary, y binary").collect()
    rows.sort(key=lambda r: (r["order"], r["x"]))
    if not rows:
        return None
    x = np.concatenate([np.frombuffer(r["x"], np.float32).reshape(-1, width) for r in rows]).astype(np.float64)
    y = np.concatenate([np.frombuffer(r["y"], np.int8) for r in rows]).astype(np.float64)
    if not 0 < y.sum() < len(y):
        return None
    held = np.concatenate([np.full(len(r["y"]), r["order"] % 4 == 0) for r in rows])
    taught = ~held
    if min(y[taught].sum(), (1 - y[taught]).sum(), y[held].sum(), (1 - y[held]).sum()) < 5:
        held = taught = np.ones(len(y), bool)
    trees = boosting.fit_trees(x[taught], y[taught])
    margin = boosting.margins(trees, x[held])
    curve = boosting.calibrate(margin, y[held])
    p = boosting.probabilities(margin, curve)
    return {"trees": trees, "curve": curve, "limits": thresholds(p, y[held], x[held, 0], precision)}


def added_spans(text: str, base: list[Span], model: dict | None) -> list[Span]:
    """Accepted proposals that touch no base span, the likeliest first, none overlapping."""
    if model is None:
        return []
    candidates = [s for s in proposals(text)
                  if not any(b[1] < s[2] and s[1] < b[2] for b in base)] if len(base) < 50 else _clear(proposals(text), base)
    if not candidates:
        return []
    x = np.array([features(text, s) for s in candidates])
    p = boosting.probabilities(boosting.margins(model["trees"], x), model["curve"])
    passing = [(float(q), s) for q, s in zip(p, candidates) if q >= model["limits"][s[0]]]
    taken: list[Span] = []
    starts: list[int] = []  # of the spans taken, which do not overlap
    for _, span in sorted(passing, key=lambda c: (-c[0], c[1][1], -c[1][2], KINDS.index(c[1][0]))):
        at = bisect_left(starts, span[1])
        if (at == 0 or taken[at - 1][2] <= span[1]) and (at == len(starts) or span[2] <= starts[at]):
            starts.insert(at, span[1])
            taken.insert(at, span)
    return taken


def _clear(spans: list[Span], base: list[Span]) -> list[Span]:
    """Spans that overlap no base span, for texts with many of them."""
    edges = np.zeros(max([s[2] for s in spans + base], default=0) + 1, np.int64)
    for _, start, end in base:
        edges[start] += 1
        edges[end] -= 1
    covered = np.r_[0, np.cumsum(np.cumsum(edges) > 0)]
    return [s for s in spans if covered[s[2]] == covered[s[1]]]


def joined(spans: list[Span]) -> str:
    ranked = sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))
    return ",".join(f"{k}:{s}:{e}" for k, s, e in ranked)


def find(docs: DataFrame, model: dict | None, text: str = "text", redact: bool = False) -> DataFrame:
    """``docs`` with n_<kind> (base spans), base_spans and spans (base and added) and, with
    ``redact``, the text with every span replaced by its kind in brackets. Columns of these names
    are replaced. Null and empty texts have no spans; spans are code points, end exclusive."""
    names = [*(f"n_{k}" for k in KINDS), "base_spans", "spans", *(["redacted"] if redact else [])]
    kept = docs.drop(*names)
    types = [pa.int64()] * len(KINDS) + [pa.string()] * (len(names) - len(KINDS))
    schema = kept.limit(0).select("*", *[F.lit(None).cast("long" if n.startswith("n_") else "string").alias(n)
                                         for n in names]).schema
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                rows = []
                for value in part.column(text):
                    value = value.as_py() or ""
                    base = base_spans(value)
                    spans = base + added_spans(value, base, shared.value)
                    kinds = [s[0] for s in base]
                    row = [*(kinds.count(k) for k in KINDS), joined(base), joined(spans)]
                    rows.append(row + [redacted(value, spans)] if redact else row)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, *(pa.array(c, t) for c, t in zip(zip(*rows), types))],
                    [*part.schema.names, *names])

    return kept.mapInArrow(run, schema)


def redacted(text: str, spans: list[Span]) -> str:
    parts, at = [], 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= at:
            parts += [text[at:start], f"[{kind}]"]
        at = max(at, end)
    return "".join([*parts, text[at:]])
