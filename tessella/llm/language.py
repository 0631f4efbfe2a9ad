"""Language ID by a bidirectional gated recurrent network over bytes.

The network reads a text's UTF-8 bytes forwards and backwards, labels every position and pools a document's probabilities
over all its positions. A text is labelled in windows of CORE bytes that overlap their neighbours by CONTEXT bytes on
either side, so that states have settled where positions count; windows begin and end between characters. The network is
trained in numpy by backpropagation through time on stretches drawn from the whole texts of a bounded sample of labelled
rows; whole texts are labelled inside tasks, many windows side by side.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import below

CORE, CONTEXT = 192, 32
WIDTH = CORE + 2 * CONTEXT
HIDDEN = 8
#: Labelled rows that training takes (those with the smallest hash of doc_id), and bytes of the stretches it draws from their whole texts.
SAMPLE_ROWS, STRETCH = 3000, 96
STEPS, BATCH, RATE = 160, 128, 0.02
#: Windows that are labelled side by side.
ABREAST = 1024
UNKNOWN = "und"


def has_letter(text: str | None) -> bool:
    """Whether a character of category L is in the text."""
    return any(map(str.isalpha, text or ""))


class BiGRU:
    """tables: per direction 3 x HIDDEN rows (reset, update, new) by byte; recur: 3H x H; out: classes x 2H."""

    def __init__(self, classes: int, hidden: int = HIDDEN, seed: int = 7):
        draw = np.random.default_rng(seed)
        self.hidden = hidden
        self.params = {
            **{f"table{d}": draw.normal(0, 0.1, (3 * hidden, 256)) for d in (0, 1)},
            **{f"recur{d}": draw.normal(0, hidden**-0.5, (3 * hidden, hidden)) for d in (0, 1)},
            "out": draw.normal(0, 0.1, (classes, 2 * hidden)),
            "bias": np.zeros((classes, 1)),
        }
        self.params = {k: v.astype(np.float32) for k, v in self.params.items()}

    def run(self, x: np.ndarray, d: int, tape: list | None = None) -> np.ndarray:
        """States (T, H, N) after each byte of x (T, N), in the order of x for either direction d."""
        h_size, table, recur = self.hidden, self.params[f"table{d}"], self.params[f"recur{d}"]
        h = np.zeros((h_size, x.shape[1]), np.float32)
        states = np.empty((len(x), h_size, x.shape[1]), np.float32)
        for t in range(len(x)) if d == 0 else range(len(x) - 1, -1, -1):
            a, g = np.take(table, x[t], axis=1), recur @ h
            gates = a[: 2 * h_size] + g[: 2 * h_size]
            gates *= 0.5
            np.tanh(gates, out=gates)
            gates *= 0.5
            gates += 0.5
            new = gates[:h_size] * g[2 * h_size :]
            new += a[2 * h_size :]
            np.tanh(new, out=new)
            if tape is not None:
                tape.append((t, h, gates, new, g[2 * h_size :]))
            h = new + gates[h_size:] * (h - new)
            states[t] = h
        return states

    def positions(self, x: np.ndarray) -> np.ndarray:
        """Probabilities (T, classes, N) of every position of x (T, N)."""
        h_size, out = self.hidden, self.params["out"]
        logits = out[:, :h_size] @ self.run(x, 0)
        logits += out[:, h_size:] @ self.run(x, 1)
        logits += self.params["bias"]
        logits -= logits.max(axis=1, keepdims=True)
        np.exp(logits, out=logits)
        logits /= logits.sum(axis=1, keepdims=True)
        return logits

    def gradients(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean weighted cross-entropy of all positions (weight (T, N)) and its gradients, back through time."""
        h_size, out = self.hidden, self.params["out"]
        tapes: list[list] = [[], []]
        states = np.concatenate([self.run(x, d, tapes[d]) for d in (0, 1)], axis=1)
        logits = out @ states + self.params["bias"]
        logits -= logits.max(axis=1, keepdims=True)
        p = np.exp(logits)
        p /= p.sum(axis=1, keepdims=True)
        chosen = np.take_along_axis(p, y[None, None, :], axis=1)[:, 0]
        loss = float(-(np.log(chosen + 1e-12) * weight).sum() / weight.sum())
        np.put_along_axis(p, np.broadcast_to(y[None, None, :], (len(x), 1, len(y))), chosen[:, None] - 1, axis=1)
        p *= (weight / weight.sum())[:, None]
        found = {"out": np.einsum("tkn,thn->kh", p, states), "bias": p.sum((0, 2))[:, None]}
        back = np.einsum("kh,tkn->thn", out, p)
        for d in (0, 1):
            recur, own = self.params[f"recur{d}"], back[:, d * h_size : (d + 1) * h_size]
            grad_recur, inputs = np.zeros_like(recur), np.empty((len(x), 3 * h_size, x.shape[1]), np.float32)
            carry = np.zeros((h_size, x.shape[1]), np.float32)
            for t, h, gates, new, inner in reversed(tapes[d]):
                grad = carry + own[t]
                reset, update = gates[:h_size], gates[h_size:]
                pre_new = grad * (1 - update) * (1 - new * new)
                pre_update = grad * (h - new) * update * (1 - update)
                pre_reset = pre_new * inner * reset * (1 - reset)
                both = np.concatenate([pre_reset, pre_update, pre_new * reset])
                grad_recur += both @ h.T
                carry = grad * update + recur.T @ both
                inputs[t, : 2 * h_size], inputs[t, 2 * h_size :] = both[: 2 * h_size], pre_new
            found[f"recur{d}"] = grad_recur
            by_byte = x.ravel()
            found[f"table{d}"] = np.stack([np.bincount(by_byte, inputs[:, k].ravel(), 256) for k in range(3 * h_size)])
        return loss, found

    def fit(self, x: np.ndarray, y: np.ndarray, mask: np.ndarray, steps: int = STEPS, seed: int = 11) -> list[float]:
        """Adam over random batches of windows x (n, T), classes y, mask (n, T) of true bytes; classes weigh alike."""
        draw = np.random.default_rng(seed)
        share = 1 / np.maximum(1, np.bincount(y, minlength=len(self.params["bias"])))
        first = {k: np.zeros_like(v) for k, v in self.params.items()}
        second = {k: np.zeros_like(v) for k, v in self.params.items()}
        losses = []
        chance = share[y] / share[y].sum()
        for step in range(1, steps + 1):
            pick = draw.choice(len(x), BATCH, p=chance)
            loss, grads = self.gradients(np.ascontiguousarray(x[pick].T), y[pick], np.ascontiguousarray(mask[pick].T).astype(np.float32))
            losses.append(loss)
            norm = np.sqrt(sum(float((g**2).sum()) for g in grads.values()))
            rate = RATE * min(1, 1 / (norm + 1e-9)) * (1 - 0.9 * step / steps)
            for k, g in grads.items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                self.params[k] -= (rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
        return losses


def windows(data: bytes, core: int = CORE, context: int = CONTEXT) -> tuple[np.ndarray, np.ndarray]:
    """The text's windows in rows, filled up with zeros, and the first and last + 1 place of each one's own bytes."""
    flat, n = np.frombuffer(data, np.uint8), len(data)
    inner = (flat & 0xC0) != 0x80  # where a character begins
    edges = [0]
    while edges[-1] < n:
        end = min(n, edges[-1] + core)
        while end < n and not inner[end] and end > edges[-1] + 1:
            end -= 1
        edges.append(end)
    at = np.array(edges[:-1], np.int64)
    own = np.array(edges[1:], np.int64) - at
    low = np.maximum(0, at - context)
    while (cut := (low > 0) & ~inner[low]).any():
        low = low + cut
    places = low[:, None] + np.arange(core + 2 * context)
    reach = np.minimum(n, at + own + context)[:, None]
    rows = np.where(places < reach, flat[np.minimum(places, n - 1)], 0).astype(np.uint8)
    return rows, np.stack([at - low, at - low + own], 1)


def train(docs: DataFrame, rows: int = SAMPLE_ROWS) -> tuple[BiGRU, list[str]]:
    """A network and its languages from docs (doc_id, text, lang), learned from at most rows of them.

    Rows without text or lang are left out. The sample is that of the smallest hashes of doc_id, so it is the same in any
    partitioning (rows that repeat an id count as one). All stretches of its texts are drawn with the same chance within a text.
    """
    known = docs.filter("lang is not null and length(text) > 0").select("doc_id", "lang", "text")
    near = below(known.select("doc_id", "lang"), 3, rows).groupBy("_hash").agg(F.min("lang").alias("lang"))
    picked = near.orderBy("_hash").limit(rows).collect()
    names = sorted({r["lang"] for r in picked})
    if not names:
        return BiGRU(1), []
    # each draw is a row, by the chance of its class, and a place in its text; tasks return the drawn stretches alone
    y = np.array([names.index(r["lang"]) for r in picked])
    share = 1 / np.bincount(y)[y]
    draw = np.random.default_rng(13)
    pick = draw.choice(len(picked), STEPS * BATCH, p=share / share.sum())
    drawn = [(picked[i]["_hash"], picked[i]["lang"], k, float(u)) for k, (i, u) in enumerate(zip(pick.tolist(), draw.random(len(pick)), strict=True))]
    wanted = docs.sparkSession.createDataFrame(drawn, "_hash long, _lang string, _draw int, _place double")
    free = F.greatest(F.length("text") - STRETCH, F.lit(0)) + 1
    stretch = F.substring(F.col("text"), F.floor(F.col("_place") * free).cast("int") + 1, F.lit(STRETCH))
    hashed = known.withColumn("_hash", F.xxhash64("doc_id", F.lit(3))).filter(F.col("_hash") <= picked[-1]["_hash"])
    met = hashed.join(F.broadcast(wanted), (hashed["_hash"] == wanted["_hash"]) & (F.col("lang") == F.col("_lang")))
    found = {r["_draw"]: r["part"] for r in met.groupBy("_draw").agg(F.min(stretch).alias("part")).collect()}
    order = sorted(found)
    parts = [found[k].encode("utf-8", "replace")[:STRETCH].decode("utf-8", "ignore").encode().replace(b"\0", b" ") for k in order]
    x = np.stack([np.frombuffer(p.ljust(STRETCH, b"\0"), np.uint8) for p in parts])
    net = BiGRU(len(names))
    net.fit(x, y[pick[order]], x != 0)
    return net, names


def document_probabilities(net: BiGRU, texts: list[str | None]) -> np.ndarray:
    """(documents, classes): the mean over all positions of each text; rows of zeros for empty ones."""
    classes = len(net.params["bias"])
    out = np.zeros((len(texts), classes))
    pending: list[tuple[np.ndarray, np.ndarray]] = []
    owner: list[np.ndarray] = []
    lengths = np.zeros(len(texts), np.int64)
    places = np.arange(WIDTH)[:, None]

    def flush() -> None:
        x, own, who = np.concatenate([p[0] for p in pending]), np.concatenate([p[1] for p in pending]), np.concatenate(owner)
        for i in range(0, len(x), ABREAST):
            part, edge = np.ascontiguousarray(x[i : i + ABREAST].T), own[i : i + ABREAST]
            p = net.positions(part)
            p *= ((places >= edge[:, 0]) & (places < edge[:, 1]))[:, None]
            np.add.at(out, who[i : i + ABREAST], p.sum(0, dtype=np.float64).T)
        pending.clear()
        owner.clear()

    waiting = 0
    for k, text in enumerate(texts):
        data = (text or "").encode("utf-8", "replace").replace(b"\0", b" ")
        lengths[k] = len(data)
        if data:
            pending.append(windows(data))
            n = len(pending[-1][0])
            owner.append(np.full(n, k))
            waiting += n
            if waiting >= ABREAST * 4:
                flush()
                waiting = 0
    if pending:
        flush()
    return out / np.maximum(1, lengths)[:, None]


def predict(docs: DataFrame, net: BiGRU, names: list[str]) -> DataFrame:
    """doc_id, lang_pred, score for every whole text: und with score 0 where it is null, has no letter, or nothing was learned."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            usable = [t if names and has_letter(t) else None for t in texts]
            p = document_probabilities(net, usable)
            best = p.argmax(1)
            found = [names[b] if t else UNKNOWN for t, b in zip(usable, best, strict=True)]
            score = [float(min(1.0, p[k, b])) if t else 0.0 for k, (t, b) in enumerate(zip(usable, best, strict=True))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, lang_pred string, score double")


def position_labels(net: BiGRU, names: list[str], text: str) -> list[str]:
    """The most likely language at every byte of one text; an empty text has none."""
    data = text.encode("utf-8", "replace").replace(b"\0", b" ")
    if not data:
        return []
    rows, own = windows(data)
    p = net.positions(np.ascontiguousarray(rows.T)).argmax(1).T
    return [names[k] for row, (a, b) in zip(p, own.tolist(), strict=True) for k in row[a:b]]


def held_out(part: int = 1, of: int = 3, id_col: str = "doc_id"):
    """Whether crc32(doc_id as text) mod `of` is `part`; a null id is not held out."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(of)) == part, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of docs (doc_id, text, lang).

    Learns from rows that aren't held out. Null or letterless texts are und with score 0; repeated rows are labelled one
    by one; an empty table gives no rows; other columns are ignored.
    """
    net, names = train(docs.filter(~held_out()))
    return predict(docs, net, names).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, least: float = 0.3) -> DataFrame:
    """docs with all its columns, without the rows whose text is und or whose language has a lower pooled probability than
    least. Rows are judged where they are read: nothing is shuffled.

    Null and letterless texts go; where no row has a lang, nothing can be learned and every text with a letter stays;
    repeated rows are judged one by one; an empty table gives none; extra columns are kept as they are.
    """
    net, names = train(docs.filter(~held_out()))
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(schema.names.index("text")).to_pylist()
            usable = [has_letter(t) for t in texts]
            score = document_probabilities(net, [t if u else None for t, u in zip(texts, usable, strict=True)]).max(1)
            yield batch.filter(pa.array([u and (not names or s >= least) for u, s in zip(usable, score.tolist(), strict=True)], pa.bool_()))

    return docs.mapInArrow(run, schema)
