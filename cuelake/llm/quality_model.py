"""Quality classifier by compression.

Two zstandard dictionaries are trained, one on good and one on bad labelled texts.  A text that
resembles the bad ones becomes smaller with their dictionary, and one that repeats itself gains from
neither.  The difference of the two compressed sizes, divided by the length, becomes a probability by logistic calibration on labelled texts that the
dictionaries haven't seen, with the class shares of all labelled rows as prior.

Input cases: null and empty texts have the difference 0 and are scored like any other.  Repeated rows
get the same score each.  Labels other than 0 and 1, and labels without a document, teach nothing.
If a class has no labelled text, every score is the share of label 1 (0.5 without labels).
"""

from __future__ import annotations

import numpy as np
import zstandard
from pyspark.sql import DataFrame, functions as F

from .common import held_out, map_rows

#: Labelled documents of each class that teach: half for its dictionary, half for calibration.
SAMPLE_DOCS = 800
#: Bytes of a dictionary, and the level of compression.
DICT_BYTES, LEVEL = 256 * 1024, 3
#: Bytes that are compressed at a time.
BLOCK = 2048
CUT = 0.7


class Sizes:
    """Compressed sizes with two dictionaries, block by block, so that a long text doesn't outgrow them."""

    def __init__(self, good: bytes, bad: bytes, level: int = LEVEL, block: int = BLOCK):
        self.block = block
        self.of = []
        for content in (bad, good):
            d = zstandard.ZstdCompressionDict(content)
            d.precompute_compress(level=level)
            self.of.append(zstandard.ZstdCompressor(level=level, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False).compress)

    def difference(self, text: str | None) -> float:
        """Bytes that the good dictionary saves over the bad one, for each byte of the text."""
        raw = (text or "").encode("utf-8", "surrogatepass")
        if not raw:
            return 0.0
        bad, good = self.of
        blocks = [raw[i : i + self.block] for i in range(0, len(raw), self.block)]
        return sum([len(bad(b)) - len(good(b)) for b in blocks]) / len(raw)


def spread(raw: list[bytes], size: int, piece: int = 256) -> bytes:
    """``size`` bytes taken evenly from all texts, and evenly from all over each text."""
    share = -(-size // (piece * len(raw)))
    out = []
    for text in raw:
        starts = range(0, len(text), max(piece, len(text) // share))
        out += [text[i : i + piece] for i in starts][:share]
    return b"\n".join(out)[:size]


def dictionary(texts: list[str], size: int = DICT_BYTES) -> bytes:
    """A dictionary from whole texts, cut into samples of 2 KB as the trainer prefers.

    Where the trainer selects less than half of the size, texts have little in common (or are too few): then pieces of all of
    them are the dictionary.
    """
    raw = [r for r in (t.encode("utf-8", "surrogatepass") for t in texts) if r]
    samples = [r[i : i + 2048] for r in raw for i in range(0, len(r), 2048)]
    if not samples:
        return b"\n"
    try:
        trained = zstandard.train_dictionary(size, samples, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        trained = b""
    return trained if 2 * len(trained) >= size else spread(raw, size)


def calibrate(x: np.ndarray, y: np.ndarray, prior: float) -> tuple[float, float, float]:
    """(centre, slope, offset) of a logistic curve through (x, y), classes weighted to have ``prior`` as share of 1."""
    centre, spread = float(x.mean()), float(x.std()) or 1.0
    z = (x - centre) / spread
    share = y.mean()
    weight = np.where(y == 1, prior / share, (1 - prior) / (1 - share))
    a, b = 0.0, float(np.log(prior / (1 - prior)))
    for _ in range(50):  # Newton's method with a slight ridge, so that separable classes have a solution
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        g = np.array([(weight * (p - y) * z).sum() + 0.1 * a, (weight * (p - y)).sum()])
        w = weight * p * (1 - p) + 1e-9
        h = np.array([[(w * z * z).sum() + 0.1, (w * z).sum()], [(w * z).sum(), w.sum()]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if abs(step).max() < 1e-9:
            break
    return centre, float(a / spread), float(b)


def train(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_DOCS) -> dict:
    """The model, from labelled documents that aren't held out; ``per_class`` of each class at most, by a hash of the id."""
    known = labels.where("quality in (0, 1)").where(~held_out()).select(F.col("doc_id").alias("label_id"), "quality").distinct()
    count = {r[0]: r[1] for r in known.groupBy("quality").count().collect()}
    total = sum(count.values())
    prior = min(0.999, max(0.001, count.get(1, 0) / total)) if total else 0.5
    if len(count) < 2:
        return {"prior": prior}
    by = F.xxhash64(F.lit("quality"), F.col("label_id"))
    ids = None
    for label in (0, 1):
        part = known.where(F.col("quality") == label).orderBy(by, "label_id").limit(per_class)
        ids = part if ids is None else ids.unionByName(part)
    # The chosen ids are few by construction, so the texts of no other document are moved.
    chosen = docs.select("doc_id", "text").join(F.broadcast(ids), F.col("doc_id") == F.col("label_id")).where("text is not null")
    rows = sorted(chosen.select("quality", "doc_id", "text").collect())
    halves = {(label, part): [t for i, t in enumerate(t for q, _, t in rows if q == label) if i % 2 == part] for label in (0, 1) for part in (0, 1)}
    if not all(halves.values()):
        return {"prior": prior}
    model = {"prior": prior, "good": dictionary(halves[1, 0]), "bad": dictionary(halves[0, 0])}
    sizes = Sizes(model["good"], model["bad"])
    x = np.array([sizes.difference(t) for label in (0, 1) for t in halves[label, 1]])
    y = np.array([label for label in (0, 1) for _ in halves[label, 1]])
    model["curve"] = calibrate(x, y, prior)
    return model


def predict(docs: DataFrame, model: dict, columns: tuple[str, ...] = ("doc_id",), cut: float = CUT) -> DataFrame:
    """``columns`` plus ``score double`` (likelihood of label 1) and ``predicted int``."""

    def make():
        if "curve" not in model:
            return lambda texts: [(model["prior"], int(model["prior"] >= cut)) for _ in texts]
        sizes = Sizes(model["good"], model["bad"])
        centre, slope, offset = model["curve"]

        def one(text):
            score = float(1 / (1 + np.exp(-min(30.0, max(-30.0, slope * (sizes.difference(text) - centre) + offset)))))
            return score, int(score >= cut)

        return lambda texts: [one(t) for t in texts]

    return map_rows(docs, make, "score double, predicted int", list(columns))


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    rows = docs.select("doc_id", "text", held_out().alias("held_out"))
    return predict(rows, train(docs, labels), ("doc_id", "held_out"))
