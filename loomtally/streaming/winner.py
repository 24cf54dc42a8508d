"""The winning line of every response while lines still arrive.

Each primary key has a state that merges lines in any order: for each request id the
best line under the batch's total order, and the figures that need no more than
sums, minima and sets. When lines arrive the responses of the key are worked out
again and emitted with a higher revision; a key that splits emits its parts, and what
it emitted before is no longer among the rows of its last revision.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from loomtally.operators.dedup import PAYLOAD
from loomtally.session import ship

OUT = (
    "pk string, final_key string, revision long, payload string, ts_start long, ts_end long, observations long, files int, "
    "violated boolean, conflict boolean, attached long, visible_chars long"
)
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def merged(a: dict | None, b: dict) -> dict:
    """What two parts of the lines of one request id are together; the order of parts does not matter."""
    if a is None:
        return b
    best = min(a, b, key=lambda x: x["order"])
    times = [t for x in (a, b) for t in x["times"]]
    chars = dict(a["chars"])
    for k, n in b["chars"].items():
        chars[k] = max(n, chars.get(k, n))
    return {
        "order": best["order"], "payload": best["payload"], "times": [min(times), max(times)] if times else [],
        "n": a["n"] + b["n"], "files": sorted({*a["files"], *b["files"]}), "same": [min(a["same"][0], b["same"][0]), max(a["same"][1], b["same"][1])],
        "chars": chars, "from_id": a["from_id"] or b["from_id"],
    }


def line_part(r) -> dict:
    """One line as a part; ``r`` has the columns that ``winners`` makes."""
    same = [int(r.input), int(r.cache_write), int(r.cache_read)]
    return {
        "order": [-int(r.output), int(r.depth), r.rel_path_k, int(r.root_idx), -int(r.line_no)], "payload": r.payload,
        "times": [] if pd.isna(r.ts_ms) else [int(r.ts_ms)] * 2, "n": 1, "files": [r.file], "same": [same, same],
        "chars": {r.char_key: int(r.visible_chars or 0)}, "from_id": bool(r.from_id),
    }


def responses_of(pk: str, parts: dict[str, dict]) -> list[dict]:
    """The responses of a primary key; ``parts`` by request id, the empty text for lines without one."""
    named = sorted(k for k in parts if k)
    split = len(named) > 1 and any(p["from_id"] for p in parts.values())
    groups: dict[str, list[str]] = {}
    for k in parts:
        groups.setdefault(f"{pk}|{k or named[0]}" if split else pk, []).append(k)
    out = []
    for final_key, keys in sorted(groups.items()):
        whole = None
        for k in keys:
            whole = merged(whole, parts[k])
        out.append(
            {
                "pk": pk, "final_key": final_key, "payload": whole["payload"], "ts_start": whole["times"][0] if whole["times"] else None,
                "ts_end": whole["times"][1] if whole["times"] else None, "observations": whole["n"], "files": len(whole["files"]),
                "violated": whole["same"][0] != whole["same"][1], "conflict": split, "attached": parts[""]["n"] if split and "" in keys else 0,
                "visible_chars": sum(whole["chars"].values()),
            }
        )
    return out


class Winner(StatefulProcessor):
    """State of a primary key: its parts by request id, and how often it was emitted."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.parts = handle.getMapState("parts", "request string", "part string")
        self.emitted = handle.getValueState("emitted", "revision long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new: dict[str, dict] = {}
        for batch in rows:
            for r in batch.itertuples(index=False):
                k = r.request_id or ""
                new[k] = merged(new.get(k), line_part(r))
        parts = {k[0]: json.loads(v[0]) for k, v in self.parts.iterator()}
        for k, part in new.items():
            parts[k] = merged(parts.get(k), part)
            self.parts.updateValue((k,), (json.dumps(parts[k]),))
        revision = (self.emitted.get()[0] if self.emitted.exists() else 0) + 1
        self.emitted.update((revision,))
        out = pd.DataFrame(responses_of(key[0], parts)).assign(revision=revision)
        longs = ["ts_start", "ts_end"]
        yield out.astype({c: "Int64" for c in longs} | {"files": "int32"})[[c.split()[0] for c in OUT.split(", ")]]

    def close(self) -> None:
        pass


def winners(responses: DataFrame) -> DataFrame:
    """Revisions of responses from a stream of response lines, to be written in update mode.

    ``responses`` has the columns of the event table and those of ``operators.dedup.with_files``.
    The rows of the highest revision of a pk are its responses (``latest``), and are those
    of ``operators.dedup.dedup_responses`` over the lines so far, in whatever order they came.
    The session needs the RocksDB state store (``use_state_store``).
    """
    ship(responses.sparkSession)
    line = F.concat_ws(":", F.lit("line"), "file_idx", "line_no")
    pk = F.coalesce("message_id", "request_id", "uuid", line)
    rows = responses.select(
        pk.alias("pk"), F.coalesce(F.col("message_id") == pk, F.lit(False)).alias("from_id"), "request_id", "output", "depth",
        F.hex("rel_path_k").alias("rel_path_k"), "root_idx", "line_no", "ts_ms", "input", "cache_write", "cache_read",
        F.coalesce("uuid", line).alias("char_key"), "visible_chars", F.col("file_idx").cast("string").alias("file"),
        F.to_json(F.struct(*PAYLOAD)).alias("payload"),
    )
    found = rows.groupBy("pk").transformWithStateInPandas(Winner(), OUT, "Update", "None")
    kind = responses.select(F.struct(*PAYLOAD).alias("p")).schema["p"].dataType
    read = found.withColumn("p", F.from_json("payload", kind.simpleString()))
    rest = [c for c in found.columns if c not in ("pk", "final_key", "revision", "payload")]
    return read.select("pk", "final_key", "revision", *(F.col(f"p.{c}").alias("complete" if c == "final" else c) for c in PAYLOAD), *rest)


def latest(revisions: DataFrame) -> DataFrame:
    """Of all revisions written so far the responses that hold; a revision that a replay wrote twice counts once."""
    w = Window.partitionBy("pk")
    last = revisions.withColumn("last", F.max("revision").over(w)).where("revision = last").drop("last", "revision")
    return last.dropDuplicates(["pk", "final_key"])


def use_state_store(spark) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
