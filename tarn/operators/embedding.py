"""Embeddings by an injected provider, the guard of a store's vector space, and the change to another one.

Vectors compare only within one provider, model and width, so a store keeps its provider's fingerprint and refuses any other. Changing it
rewrites every vector by pages into a ledger named by the new fingerprint: the mark that a change is going on comes first, pages that are
complete are never embedded again, and tables switch only when all their pages are there. Until the mark goes, the store refuses to serve.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.functions.vectors import hash_embed
from tarn.sources.ledger import Ledger
from tarn.sources.store import Store

BATCH, PAGES = 64, 16


@dataclass(frozen=True)
class Provider:
    """``embed`` makes a vector of ``dims`` numbers of each text of a batch; it runs in the tasks."""

    dims: int
    fingerprint: str
    embed: Callable[[list[str]], list]


def offline(dims: int) -> Provider:
    return Provider(dims, f"token-hashes-{dims}", lambda texts: [hash_embed(t, dims) for t in texts])


class WrongSpace(Exception):
    """The store's vectors are another provider's, or a change of them is not finished."""

    def __init__(self, stored: str | None, wanted: str, unfinished: bool) -> None:
        super().__init__(f"unfinished change to {stored}" if unfinished else f"the store holds vectors of {stored}, not of {wanted}")
        self.stored, self.wanted, self.unfinished = stored, wanted, unfinished


def embedded(rows: DataFrame, text: str, provider: Provider, name: str = "embedding") -> DataFrame:
    """``rows`` with the provider's vector of their text; null texts count as empty, and no call holds more than BATCH."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(text).to_pylist()]
            made = [v for i in range(0, len(texts), BATCH) for v in provider.embed(texts[i : i + BATCH])]
            if len(made) != len(texts) or any(len(v) != provider.dims for v in made):
                raise ValueError(f"{provider.fingerprint} gave something else than {len(texts)} vectors of {provider.dims}")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([list(map(float, v)) for v in made], pa.list_(pa.float64()))], [*batch.schema.names, name])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{kinds}, `{name}` array<double>")


def guard(store: Store, provider: Provider, tolerate: bool = False) -> None:
    """Marks a new store with the provider's fingerprint; refuses any other provider, and a store whose change is not finished.

    ``tolerate`` is the way in for reembed().
    """
    meta = store.meta()
    if tolerate:
        return
    if "reembed" in meta:
        raise WrongSpace(meta["reembed"]["to"], provider.fingerprint, True)
    if "fingerprint" not in meta:
        store.set_meta(meta | {"fingerprint": provider.fingerprint})
    elif meta["fingerprint"] != provider.fingerprint:
        raise WrongSpace(meta["fingerprint"], provider.fingerprint, False)


def reembed(store: Store, texts: dict[str, str], provider: Provider, pages: int = PAGES, force: bool = False) -> dict:
    """All vectors of the tables (name -> its text column; each with id and embedding) by the provider: outcome, from, to and rows a table.

    Begun again after a failure, it goes on with the pages that are missing; a change to yet another provider starts anew from the
    tables as they were. Tables in buckets are not rewritten here.
    """
    meta, counts = store.meta(), {}
    stored, going = meta.get("fingerprint"), meta.get("reembed", {})
    for name in texts:
        width = store.read(name).filter("embedding is not null").select(F.size("embedding").alias("n")).limit(1).collect()
        if width and width[0]["n"] != provider.dims:
            raise ValueError(f"vectors of {name} have {width[0]['n']} numbers, {provider.fingerprint} makes {provider.dims}")
    if going.get("to") != provider.fingerprint:
        whole = all(store.read(name).filter("embedding is null").isEmpty() for name in texts)
        if stored == provider.fingerprint and not going and whole and not force:
            return {"outcome": "up-to-date", "from": stored, "to": provider.fingerprint, "rows": dict.fromkeys(texts, 0)}
        source = going.get("source") or {name: store.newest(name) for name in texts}
        store.set_meta(meta | {"reembed": {"to": provider.fingerprint, "source": source}})
        going = store.meta()["reembed"]
    place = hashlib.sha256(provider.fingerprint.encode()).hexdigest()[:16]
    for name, text in texts.items():
        source = store.spark.read.parquet(going["source"][name])
        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.drop("embedding").schema)
        ledger = Ledger(store.spark, f"{store.root}/_reembed/{place}-{going['source'][name].rpartition('/')[2]}", f"{kinds}, embedding array<double>")
        page = F.pmod(F.xxhash64("id"), F.lit(pages))
        for k in range(pages):
            if not ledger.has(f"{name}-{k:05d}"):
                ledger.put(f"{name}-{k:05d}", embedded(source.filter(page == k).drop("embedding"), text, provider))
        if store.newest(name) == going["source"][name]:  # else it switched before the end was cut off
            store.write(name, ledger.read(f"{name}-"))
        counts[name] = store.read(name).count()
    store.set_meta({k: v for k, v in store.meta().items() if k != "reembed"} | {"fingerprint": provider.fingerprint})
    return {"outcome": "reembedded", "from": stored, "to": provider.fingerprint, "rows": counts}
