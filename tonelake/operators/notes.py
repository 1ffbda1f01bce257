"""Pressed notes routed through instrument keymaps to the items they sound."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST_FRAMES = 512


def reachable(slots: DataFrame, frames: str = "frames", least: int = LEAST_FRAMES) -> DataFrame:
    """Slots whose waveform is long enough to be catalogued."""
    return slots.where(F.col(frames) >= least)


def resolve(events: DataFrame, keymap: DataFrame, slots: DataFrame, module: str = "module_id") -> DataFrame:
    """``events`` with ``sounded_note`` and ``slot``.

    ``keymap`` (module, instrument, note, sounded_note, sample) says what a key sounds; ``slots`` (module, instrument,
    sample, slot) where the catalogue holds that sample. An event without an instrument, or on a key the keymap leaves
    silent, stays open; one routed to a sample that is not catalogued keeps its note and has no slot.
    """
    routed = events.join(keymap.select(module, "instrument", "note", "sounded_note", "sample"), [module, "instrument", "note"], "left")
    return routed.join(slots.select(module, "instrument", "sample", "slot"), [module, "instrument", "sample"], "left").drop("sample")
