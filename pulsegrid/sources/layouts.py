"""Binary layouts of packets and readouts: (field, offset, bytes, signed). All integers are little-endian."""

from __future__ import annotations

# Fixed values of the wire format.
HEADER = [
    ("pad", 0, 1, False), ("version", 1, 1, False), ("cookie", 2, 3, False), ("type", 5, 1, False), ("total_length", 6, 2, False), ("queue", 8, 1, False),
    ("time_source", 9, 1, False), ("pulse_high", 10, 4, False), ("pulse_low", 14, 4, False), ("prev_high", 18, 4, False), ("prev_low", 22, 4, False), ("seq", 26, 4, False),
]
COMMON = [("fiber", 0, 1, False), ("fen", 1, 1, False), ("length", 2, 2, False), ("time_high", 4, 4, False), ("time_low", 8, 4, False)]
CAEN = [*COMMON, ("flags", 12, 1, False), ("grp", 13, 1, False), ("unused", 14, 2, False), ("amp_a", 16, 2, True), ("amp_b", 18, 2, True), ("amp_c", 20, 2, True), ("amp_d", 22, 2, True)]
VMM3 = [*COMMON, ("bc", 12, 2, False), ("otadc", 14, 2, False), ("geo", 16, 1, False), ("tdc", 17, 1, False), ("vmm", 18, 1, False), ("channel", 19, 1, False)]
CBM = [*COMMON, ("kind", 12, 1, False), ("channel", 13, 1, False), ("adc", 14, 2, False), ("x", 16, 2, False), ("y", 18, 2, False), ("value24", 16, 3, False), ("mca_sum", 19, 1, False)]
CDT = [*COMMON, ("om", 12, 1, False), ("unit", 13, 1, False), ("cathode", 14, 1, False), ("anode", 15, 1, False)]
EVR = [("kind", 0, 1, False), ("counter", 4, 4, False), ("pulse_s", 8, 4, False), ("pulse_ns", 12, 4, False), ("prev_s", 16, 4, False), ("prev_ns", 20, 4, False)]
SIZES = {"caen": 24, "vmm3": 20, "cbm": 20, "cdt": 16, "trex": 24}
LAYOUTS = {"caen": CAEN, "vmm3": VMM3, "cbm": CBM, "cdt": CDT, "trex": CAEN}
