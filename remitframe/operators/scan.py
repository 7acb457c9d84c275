"""Carried state over ordered segments, as a two-level scan.

A file's meaning depends on order: payer and member carry forward, a claim owns what follows it,
lines are numbered. A window per file would put a huge file in one task, and any window would sort
and shuffle the text of all segments. But segments come out of their blocks in order already. So one pass
over the rows of a task, column by column in Arrow batches, gives each segment the state within its
chunk; one row per chunk sums up the state at its end, a window over those few rows gives the state
at each chunk's start, and the two are put together per segment. Every carried value is "last non-null"
or a sum, so the result is exact. The text of segments is never shuffled or sorted.

What belongs to an earlier segment (a service date to its line) is handed back to it in the same pass.
Only where the owner lies in an earlier chunk the segment is ``loose`` and meets it by a join; there is
at most one owner of each kind per chunk.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from remitframe.functions.edi import entity_id
from remitframe.operators.segments import with_elements, with_family
from remitframe.session import BROADCAST_ROWS, fits_broadcast

# Tasks get these functions with their code: the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_KEYS = ["upload_seq", "chunk"]

# What a chunk's rows need to be put in their state.
_FACTS = ("clm_ok", "sv1_ok", "dx_count", "clp_ok", "payer_set", "member_set", "remit_day",
          "service_day", "control_no", "st_type", "own_number")
# Names of segments that read a carried value; elsewhere it is kept only at the chunk's end.
_READ_ON = {
    "CLM": ("l_payer", "l_member"),
    "SV1": ("l_claim_number", "sv1_cum", "l_sv1_base"),
    "HI": ("dx_cum", "l_dx_base"),
    "CLP": ("l_remit_day",),
    "DTP": ("l_owner", "l_owner_ln"),
}
_STATE = ("ln int, is_last boolean, chunk_type string, sv1_cum long, dx_cum long, l_payer string, "
          "l_member string, l_remit_day date, l_claim_number string, l_claim_ln int, "
          "l_remit_ln int, l_owner_ln int, l_owner string, l_sv1_base long, l_dx_base long, "
          "own_day date, own_control string, own_remit_day date, loose boolean")
# Columns that nothing needs behind the scan.
_USED_UP = ("idx", "block_seq", "payer_set", "member_set", "remit_day", "service_day", "control_no",
            "st_type", "own_number")


def _flags(column: pa.Array) -> np.ndarray:
    return column.fill_null(False).to_numpy(zero_copy_only=False)


class _Chunks:
    """Rows of whole chunks, one after the other, with the state of each row in its chunk."""

    def __init__(self, rows: pa.Table):
        self.rows, self.n = rows, rows.num_rows
        keys = [rows[k].to_numpy() for k in _KEYS]
        changed = np.zeros(self.n, bool)
        changed[:1] = True
        for key in keys:
            changed[1:] |= key[1:] != key[:-1]
        self.starts = np.flatnonzero(changed)
        self.first = self.starts[np.cumsum(changed) - 1]      # of each row's chunk
        self.place = np.arange(self.n)
        self.is_last = np.append(changed[1:], True)

    def last_place(self, flags: np.ndarray) -> np.ndarray:
        """The last row up to each one, in its chunk, with the flag; -1 without."""
        found = np.maximum.accumulate(np.where(flags, self.place, -1))
        return np.where(found >= self.first, found, -1)

    def running(self, values: np.ndarray) -> np.ndarray:
        total = np.cumsum(values)
        return total - (total - values)[self.first]

    def taken(self, values: pa.Array, places: np.ndarray, wanted: np.ndarray) -> pa.Array:
        return values.take(pa.array(places, mask=(places < 0) | ~wanted))

    def handed_back(self, values: pa.Array, owners: np.ndarray) -> tuple[pa.Array, np.ndarray]:
        """For each row the last value that it owns, and which values have no owner here."""
        given = values.is_valid().to_numpy(zero_copy_only=False)
        source = np.full(self.n, -1)
        here = given & (owners >= 0)
        source[owners[here]] = self.place[here]    # of several, the last one stays
        return values.take(pa.array(source, mask=source < 0)), given & (owners < 0)

    def state(self) -> dict[str, pa.Array]:
        column = {c: self.rows[c].combine_chunks() for c in (*_FACTS, "segment_name")}
        name = column["segment_name"].to_numpy(zero_copy_only=False)
        clm, sv1, clp = (_flags(column[c]) for c in ("clm_ok", "sv1_ok", "clp_ok"))
        ln = pa.array(self.place - self.first + 1, pa.int32())
        sv1_cum = self.running(sv1.astype(np.int64))
        dx_cum = self.running(column["dx_count"].fill_null(0).to_numpy().astype(np.int64))
        wanted = {c: self.is_last.copy() for read in _READ_ON.values() for c in read}
        for segment, read in _READ_ON.items():
            here = name == segment
            for c in read:
                wanted[c] |= here
        always = np.ones(self.n, bool)
        claim, remit = self.last_place(clm), self.last_place(clp)
        owner = self.last_place(clm | sv1 | (name == "HI"))
        typed = np.where(column["st_type"].is_valid().to_numpy(zero_copy_only=False), self.place,
                         self.n)
        first_type = np.minimum.reduceat(typed, self.starts)[
            np.searchsorted(self.starts, self.first)]
        # A date behind a line is the line's, one behind a claim or its diagnoses the claim's.
        dated = np.where((owner >= 0) & (name[owner] != "SV1"), claim, owner)
        own_day, day_loose = self.handed_back(column["service_day"], dated)
        own_control, control_loose = self.handed_back(column["control_no"], claim)
        own_remit_day, remit_loose = self.handed_back(column["remit_day"], remit)
        sums = {"sv1_cum": pa.array(sv1_cum), "dx_cum": pa.array(dx_cum)}

        def last(fact, carried):
            valid = column[fact].is_valid().to_numpy(zero_copy_only=False)
            return self.taken(column[fact], self.last_place(valid), wanted[carried])
        return {
            "ln": ln, "is_last": pa.array(self.is_last),
            "chunk_type": column["st_type"].take(pa.array(
                first_type, mask=first_type == self.n)),
            **{c: self.taken(v, self.place, wanted[c]) for c, v in sums.items()},
            "l_payer": last("payer_set", "l_payer"), "l_member": last("member_set", "l_member"),
            "l_remit_day": last("remit_day", "l_remit_day"),
            "l_claim_number": self.taken(column["own_number"], claim, wanted["l_claim_number"]),
            "l_claim_ln": self.taken(ln, claim, always), "l_remit_ln": self.taken(ln, remit, always),
            "l_owner_ln": self.taken(ln, owner, wanted["l_owner_ln"]),
            "l_owner": self.taken(column["segment_name"], owner, wanted["l_owner"]),
            "l_sv1_base": self.taken(sums["sv1_cum"], claim, wanted["l_sv1_base"]),
            "l_dx_base": self.taken(sums["dx_cum"], claim, wanted["l_dx_base"]),
            "own_day": own_day, "own_control": own_control, "own_remit_day": own_remit_day,
            "loose": pa.array(day_loose | control_loose | remit_loose),
        }


def whole_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of a task in tables that never end within a chunk."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        # The last chunk of a batch may go on in the next one.
        cut = batch.num_rows - 1
        keys = [batch[k].to_numpy() for k in _KEYS]
        same = np.logical_and.reduce([k == k[-1] for k in keys])
        cut = 0 if same.all() else int(np.flatnonzero(~same)[-1]) + 1
        goes_on = held and all(held[-1][k][-1] == batch[k][0] for k in _KEYS)
        if cut or (held and not goes_on):
            yield from _table([*held, batch.slice(0, cut)])
            held = []
        held.append(batch.slice(cut))
    yield from _table(held)


def _table(batches: list[pa.RecordBatch]) -> Iterator[pa.Table]:
    if any(b.num_rows for b in batches):
        yield pa.Table.from_batches(batches)


def local_scan(marked: DataFrame) -> DataFrame:
    """Running state within each chunk.

    The rows of a chunk have to lie in one partition, in order and not between those of others, as
    they come from ``explode_segments``. A chunk is what a task holds at a time.
    """
    marked = marked.drop("idx", "block_seq")   # places, which the order of the rows tells as well
    kept = [f for f in marked.schema if f.name not in _USED_UP]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", " + _STATE
    names = [f.name for f in kept]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_chunks(batches):
            state = _Chunks(rows).state()
            table = pa.table([*[rows[n] for n in names], *state.values()],
                             names=[*names, *state])
            yield from table.to_batches(max_chunksize=20_000)
    return with_elements(with_family(marked.mapInArrow(scan, schema)))


def check_chunks(carry_ends: DataFrame) -> None:
    """Fails if a chunk's rows did not lie together, which would break the scan."""
    twice = carry_ends.groupBy(*_KEYS).count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"the blocks of {twice[0]} do not lie together in one partition")


def chunk_carry(scanned: DataFrame) -> DataFrame:
    """State at the start of every chunk, for files that have more than one chunk."""
    ends = scanned.where("is_last").select(
        *_KEYS, "ln", "chunk_type", "sv1_cum", "dx_cum", "l_payer", "l_member", "l_remit_day",
        "l_claim_number", "l_claim_ln", "l_remit_ln", "l_owner_ln", "l_owner", "l_sv1_base",
        "l_dx_base")
    check_chunks(ends)
    per_file = Window.partitionBy("upload_seq")
    before = per_file.orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    whole = per_file.orderBy("chunk").rowsBetween(Window.unboundedPreceding,
                                                  Window.unboundedFollowing)

    def total(c):
        return F.coalesce(F.sum(c).over(before), F.lit(0))

    def last(value):
        return F.last(value, ignorenulls=True).over(before)
    offsets = ends.withColumns({
        "chunks": F.count(F.lit(1)).over(whole),
        "file_type": F.first("chunk_type", ignorenulls=True).over(whole),
        "c_offset": total("ln"), "c_sv1": total("sv1_cum"), "c_dx": total("dx_cum"),
    }).where("chunks > 1")
    return offsets.select(
        *_KEYS, F.col("file_type").alias("c_type"), "c_offset",
        last(F.col("l_payer")).alias("c_payer"), last(F.col("l_member")).alias("c_member"),
        last(F.col("l_remit_day")).alias("c_remit_day"),
        last(F.col("l_claim_number")).alias("c_claim_number"),
        last(F.col("c_offset") + F.col("l_claim_ln")).alias("c_claim_pos"),
        last(F.col("c_offset") + F.col("l_remit_ln")).alias("c_remit_pos"),
        last(F.col("c_offset") + F.col("l_owner_ln")).alias("c_owner_pos"),
        last(F.col("l_owner")).alias("c_owner"),
        # Lines and diagnoses seen since the claim that is open at the chunk's start.
        (F.col("c_sv1") - last(F.col("c_sv1") + F.col("l_sv1_base"))).alias("c_sv1_since"),
        (F.col("c_dx") - last(F.col("c_dx") + F.col("l_dx_base"))).alias("c_dx_since"),
    )


def apply_carry(scanned: DataFrame, carry: DataFrame,
                limit: int = BROADCAST_ROWS) -> DataFrame:
    """Combine chunk-local state with the state at the chunk's start.

    ``carry`` has one row per chunk of a multi-chunk file and should be stored, as its size is
    checked here: it is broadcast while small and shuffled otherwise.
    """
    side = F.broadcast(carry) if fits_broadcast(carry, limit) else carry
    joined = with_elements(scanned.join(side, _KEYS, "left"))
    offset = F.coalesce("c_offset", F.lit(0))

    def position(local, carried):
        return F.coalesce(offset + F.col(local), F.col(carried)).cast("int")

    def since_claim(cum, base, carried):
        return F.when(F.col("l_claim_ln").isNotNull(), F.col(cum) - F.col(base)).otherwise(
            F.col(carried) + F.col(cum)).cast("int")
    state = joined.select(
        "upload_seq", "family", "segment_name", "raw_segment_text", "elements", "element_sep",
        "component_sep", "clm_ok", "sv1_ok", "clp_ok", "dx_count",
        "raw_rule", "row_rule", "own_day", "own_control", "own_remit_day", "loose",
        F.coalesce("c_type", "chunk_type").alias("file_type"),
        (offset + F.col("ln")).cast("int").alias("seg_pos"),
        F.coalesce("l_payer", "c_payer").alias("payer_name"),
        F.coalesce("l_member", "c_member").alias("patient_member_id"),
        F.coalesce("l_remit_day", "c_remit_day").alias("remit_day"),
        F.coalesce("l_claim_number", "c_claim_number").alias("open_claim_number"),
        position("l_claim_ln", "c_claim_pos").alias("claim_pos"),
        position("l_remit_ln", "c_remit_pos").alias("remit_pos"),
        position("l_owner_ln", "c_owner_pos").alias("owner_pos"),
        F.coalesce("l_owner", "c_owner").alias("owner"),
        since_claim("sv1_cum", "l_sv1_base", "c_sv1_since").alias("line_number"),
        # Diagnoses of the claim before this segment.
        (since_claim("dx_cum", "l_dx_base", "c_dx_since") - F.col("dx_count")).alias("dx_before"),
    )
    # Segments before the first good CLM have no owner: a line or HI there has failed. Claim
    # state belongs to submissions and remittance state to remittances.
    is_837, is_835 = F.col("file_type") == "edi_837", F.col("file_type") == "edi_835"
    open_claim = is_837 & F.col("claim_pos").isNotNull()
    return state.where(F.col("file_type").isNotNull()).withColumns({
        "claim_pos": F.when(is_837, F.col("claim_pos")),
        "remit_pos": F.when(is_835, F.col("remit_pos")),
        "owner_pos": F.when(open_claim, F.col("owner_pos")),
        "owner": F.when(open_claim, F.col("owner")),
        "clm_ok": F.col("clm_ok") & is_837, "clp_ok": F.col("clp_ok") & is_835,
        "sv1_ok": F.col("sv1_ok") & open_claim,
    }).withColumns({
        "claim_id": F.when(F.col("claim_pos").isNotNull(),
                           entity_id(F.col("upload_seq"), F.col("claim_pos"))),
        "remittance_claim_id": F.when(F.col("remit_pos").isNotNull(),
                                      entity_id(F.col("upload_seq"), F.col("remit_pos"))),
    })
