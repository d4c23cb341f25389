"""Pixel ids as Column expressions: dense 1-based ids of logical geometries, null where a coordinate is off the grid.

Sinks that need the sentinel 0 restore it with with_sentinel().
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pulsegrid.functions.timebase import div

# Logical grids (x, y) of the instruments.
GRIDS = {
    "freia": (64, 1024), "amor": (64, 448), "estia": (1536, 128), "nmx": (1280, 1280),
    "bifrost": (900, 15), "miracles": (48, 128), "cspec": (900, 180), "tbl3he": (100, 8),
}
TREX_GRID = (384, 140, 16)


def pixel2d(x: Column, y: Column, nx: int, ny: int) -> Column:
    return F.when((x >= 0) & (x < nx) & (y >= 0) & (y < ny), x + y * nx + 1).cast("long")


def pixel3d(x: Column, y: Column, z: Column, nx: int, ny: int, nz: int) -> Column:
    return F.when((z >= 0) & (z < nz), pixel2d(x, y, nx, ny) + z * (nx * ny)).cast("long")


def pixel_panels2d(x: Column, y: Column, panel: Column, nx: int, ny: int, panels: int) -> Column:
    return F.when((panel >= 0) & (panel < panels), pixel2d(x, y, nx, ny) + panel * (nx * ny)).cast("long")


def pixel_panels3d(x: Column, y: Column, z: Column, panel: Column, nx: int, ny: int, nz: int, panels: int) -> Column:
    return F.when((panel >= 0) & (panel < panels), pixel3d(x, y, z, nx, ny, nz) + panel * (nx * ny * nz)).cast("long")


def with_sentinel(pixel: Column) -> Column:
    return F.coalesce(pixel, F.lit(0).cast("long"))


def strip(offset: Column | int, channel: Column) -> Column:
    """Strip coordinate; null beyond 16 bits."""
    c = F.lit(offset) + 63 - channel if isinstance(offset, int) else offset + 63 - channel
    return F.when(c.between(0, 65535), c)


def wire(offset: Column | int, channel: Column) -> Column:
    c = F.lit(offset) + 47 - channel if isinstance(offset, int) else offset + 47 - channel
    return F.when(c.between(0, 65535), c)


def estia_wire(offset: Column, channel: Column) -> Column:
    c = offset + channel - 16
    return F.when(c.between(0, 65535), c)


def estia_offsets(cassette: Column) -> tuple[Column, Column]:
    return (cassette % 48) * 32, div(cassette, 48) * 64


def nmx_coordinate(channel: Column, asic: Column, offset: Column, reverse: Column) -> Column:
    return F.when(reverse, offset + (1 - asic) * 64 + 63 - channel).otherwise(offset + asic * 64 + channel)


# Hybrid of the wires and hybrid of the short grids, of LET.
LET_WIRES, LET_SHORT_GRIDS = 1, 0


def trex_wire(fen: Column, hybrid: Column, asic: Column, channel: Column, rotated: Column, x_offset: Column, wires: int = 0) -> Column:
    """Wire coordinate (column times 16 plus depth); odd FENs are the second column of a vessel, rotation mirrors its twelve columns.

    ``wires`` is the hybrid that reads wires. LET takes its own (LET_WIRES), channels swapped (swap_odd_even), and even rings
    as the second column.
    """
    valid = (hybrid == wires) & F.when(asic == 0, channel.between(32, 63)).otherwise(channel.between(0, 63))
    n = asic * 64 + channel - 32 + F.when(fen % 2 == 1, 96).otherwise(0)
    turned = F.when(rotated, (11 - div(n, 16)) * 16 + n % 16).otherwise(n)
    return F.when(valid, turned + 16 * x_offset)


def trex_grid(hybrid: Column, asic: Column, channel: Column, short: Column, rotated: Column, y_offset: Column, short_hybrid: int = 1) -> Column:
    """Grid coordinate in 16-bit unsigned arithmetic; short vessels have 51 grids on one VMM (LET: LET_SHORT_GRIDS), full ones 140 on four."""
    full = F.when(hybrid == 1, F.when(asic == 0, channel.between(58, 63)).otherwise(True)).when(hybrid == 2, F.when(asic == 1, channel <= 5).otherwise(True)).otherwise(False)
    valid = F.when(short, (hybrid == short_hybrid) & (asic == 0) & (channel <= 50)).otherwise(full)
    y = F.when(short, channel).otherwise((hybrid * 2 + asic - 2) * 64 + channel - 58)
    return F.when(valid, (F.when(rotated, -y).otherwise(y) + y_offset).cast("int").bitwiseAND(0xFFFF))


def swap_odd_even(channel: Column) -> Column:
    return F.when(channel % 2 == 0, channel + 1).otherwise(channel - 1)


def trex_pixel(wire_: Column, grid: Column) -> Column:
    return pixel3d(div(wire_, 16), grid, wire_ % 16, *TREX_GRID)


def vmm_pixel(a_center: Column, b_center: Column, nx: int, ny: int) -> Column:
    """Both centres rounded to the nearest coordinate."""
    return pixel2d(F.round(a_center).cast("long"), F.round(b_center).cast("long"), nx, ny)


def loki(bank_y: Column, groups_n: Column, fen_offset: Column, fen: Column, g: Column, unit: Column, position: Column, resolution: int, total_groups: int) -> Column:
    y = bank_y + (g % 4) * groups_n * 7 + (fen_offset + fen) * 14 + 7 * div(g, 4) + unit
    return pixel2d(F.round(position * (resolution - 1)).cast("long"), y, resolution, total_groups * 7)


def loki_group(bank_y: Column, groups_n: Column, fen_offset: Column, fen: Column, g: Column) -> Column:
    """The tube group within the whole instrument, by which calibrations are kept."""
    return div(bank_y, 7) + (g % 4) * groups_n + (fen_offset + fen) * 2 + div(g, 4)


def bifrost(ring: Column, g: Column, unit: Column, relative: Column, resolution: int = 300) -> Column:
    x = ring * resolution + (g % 3) * 100 + (relative * 99).cast("long")
    return pixel2d(x, div(g, 3) * 3 + unit, *GRIDS["bifrost"])


def miracles(ring: Column, tube: Column, a: Column, b: Column, resolution: int = 128) -> Column:
    """The position is rounded to single precision; the rest is in double precision."""
    half = resolution // 2
    p = (a.cast("double") / (a + b)).cast("float").cast("double")
    near = a >= b
    x = 2 * tube + F.when(ring.isin(1, 3), 24).otherwise(0) + F.when(near, 0).otherwise(1)
    y = F.when(near, F.round((half - 1) - (p - 0.5) * 2 * (half - 1)).cast("long")).otherwise((p * 2 * (half - 1)).cast("long"))
    return pixel2d(x, y + F.when(ring.isin(2, 3), half).otherwise(0), *GRIDS["miracles"])


def cspec(ring: Column, g: Column, a: Column, b: Column, resolution: int = 75) -> Column:
    nx, ny = GRIDS["cspec"]
    return pixel2d(ring * resolution + (g % 24) * div(F.lit(resolution), 24), F.when(a + b != 0, div((resolution - 1) * a, a + b)), nx, ny)


def tbl3he(bank: Column, g: Column, position: Column) -> Column:
    return pixel2d((position * 99).cast("long"), bank * 4 + g, *GRIDS["tbl3he"])


def clamp01(position: Column) -> tuple[Column, Column]:
    """Position clamped to 0..1, and ``low``/``high`` where it was clamped."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), position)), F.when(position < 0, "low").when(position > 1, "high")


def cubic(position: Column, a: Column, b: Column, c: Column, d: Column) -> Column:
    return position - (a + position * (b + position * (c + position * d)))


# CDT modules -----------------------------------------------------------------------------------------------------------

# X offset of a SUMO within its sector, by SUMO number n; it has 2 n - 2 cassettes.
SUMO_X = {3: 48, 4: 36, 5: 20, 6: 0}
MAX_SECTOR = 22


def _high(channel: Column, bits: int) -> Column:
    """A channel number, which is not negative, div a power of two; a shift takes far less generated code than a division."""
    return F.shiftright(channel, bits)


def _low(channel: Column, bits: int) -> Column:
    """A channel number, which is not negative, mod a power of two."""
    return channel.bitwiseAND(2**bits - 1)


def cdt_parts(anode: Column) -> tuple[Column, Column]:
    """(counter, wire) of an anode channel."""
    return _low(_high(anode, 4), 1), _low(anode, 4)


def sumo_cassette(sumo: Column, anode: Column, cathode: Column) -> Column:
    """Cassette by SUMO number (one of SUMO_X), in 8-bit unsigned arithmetic."""
    layer = F.when(sumo == 3, _high(cathode, 5)).otherwise(_high(cathode, 4))
    value = 2 * layer + F.when(sumo == 6, -_high(anode, 5)).otherwise(_high(anode, 5)) - F.when(sumo == 4, 1).otherwise(0)
    return value.cast("int").bitwiseAND(255)


def sumo_xy(sector: Column, number: Column, cassette: Column, anode: Column, cathode: Column) -> tuple[Column, Column]:
    counter, wire_ = cdt_parts(anode)
    offset = F.coalesce(*(F.when(number == n, F.lit(x)) for n, x in SUMO_X.items()))
    return F.when((sector <= MAX_SECTOR) & (cassette < 2 * number - 2), sector * 56 + offset + 2 * cassette + counter), _low(cathode, 4) * 16 + wire_


def sumo(sector: Column, number: Column, anode: Column, cathode: Column, nx: int, ny: int) -> Column:
    return pixel2d(*sumo_xy(sector, number, sumo_cassette(number, anode, cathode), anode, cathode), nx, ny)


def mantle_parts(anode: Column) -> tuple[Column, Column]:
    """(counter, wire) of an anode channel of a mantle, which has 32 wires a counter."""
    return _low(_high(anode, 5), 1), _low(anode, 5)


def mantle_xy(unit: Column, cassette: Column, anode: Column, cathode: Column, strips: int = 256) -> tuple[Column, Column]:
    """``unit`` (mounting unit) and ``cassette`` come from the module's configuration; ``strips`` is 256 or 128 a cassette."""
    counter, wire_ = mantle_parts(anode)
    return cathode % strips, 60 * wire_ + 12 * unit + 2 * cassette + counter


def mantle(unit: Column, cassette: Column, anode: Column, cathode: Column, strips: int = 256) -> Column:
    return pixel2d(*mantle_xy(unit, cassette, anode, cathode, strips), strips, 1920)


def heimdal_xy(unit: Column, cassette: Column, anode: Column, cathode: Column, strips: int = 64) -> tuple[Column, Column]:
    counter, wire_ = mantle_parts(anode)
    return 12 * unit + 2 * cassette + counter, cathode % strips + wire_ * strips


def heimdal(unit: Column, cassette: Column, anode: Column, cathode: Column, strips: int = 64) -> Column:
    return pixel2d(*heimdal_xy(unit, cassette, anode, cathode, strips), 144, 2048)


def cuboid_cell(anode: Column, cathode: Column) -> tuple[Column, Column]:
    """(x, y) of a cell within its layer of an unturned cuboid."""
    counter, wire_ = cdt_parts(anode)
    return 2 * (_high(anode, 5) + 2 * _high(cathode, 5)) + counter, 15 - wire_


# By quarter turns clockwise, x and y of a turned cell, each as (constant, times x, times y).
TURNS = (((0, 1, 0), (0, 0, 1)), ((15, 0, -1), (0, 1, 0)), ((15, -1, 0), (15, 0, -1)), ((0, 0, 1), (15, -1, 0)))


def turned(rotation: Column, x_offset: Column, y_offset: Column) -> Column:
    """How a cuboid of 16 x 16 cells stands: x0, xx, xy, y0, yx, yy of turned_xy."""
    term = lambda axis, i: F.when(rotation == 1, TURNS[1][axis][i]).when(rotation == 2, TURNS[2][axis][i]).when(rotation == 3, TURNS[3][axis][i]).otherwise(TURNS[0][axis][i])
    return F.struct((x_offset + term(0, 0)).alias("x0"), term(0, 1).alias("xx"), term(0, 2).alias("xy"), (y_offset + term(1, 0)).alias("y0"), term(1, 1).alias("yx"), term(1, 2).alias("yy"))


def turned_xy(x: Column, y: Column, cathode: Column, stands: Column) -> tuple[Column, Column]:
    """Place of the cell (``x``, ``y``: cuboid_cell) of a cuboid, in layers of 112 rows."""
    return stands["x0"] + stands["xx"] * x + stands["xy"] * y, 112 * _low(cathode, 5) + stands["y0"] + stands["yx"] * x + stands["yy"] * y


def cuboid(anode: Column, cathode: Column, rotation: Column, x_offset: Column, y_offset: Column, nx: int, ny: int) -> Column:
    return pixel2d(*turned_xy(*cuboid_cell(anode, cathode), cathode, turned(rotation, x_offset, y_offset)), nx, ny)


# X offset, y offset and quarter turns of the cuboids of two detectors, by their index.
CUBOIDS = {
    "sans": [
        (32, 0, 0), (48, 0, 1), (64, 0, 1),
        (16, 16, 0), (32, 16, 0), (48, 16, 1), (64, 16, 1), (80, 16, 1),
        (0, 32, 0), (16, 32, 0), (32, 32, 0), (48, 32, 1), (64, 32, 1), (80, 32, 1), (96, 32, 1),
        (0, 48, 0), (16, 48, 0), (32, 48, 0), (64, 48, 2), (80, 48, 2), (96, 48, 2),
        (0, 64, 3), (16, 64, 3), (32, 64, 3), (48, 64, 3), (64, 64, 2), (80, 64, 2), (96, 64, 2),
        (16, 80, 3), (32, 80, 3), (48, 80, 3), (64, 80, 2), (80, 80, 2),
        (32, 96, 3), (48, 96, 3), (64, 96, 2),
    ],
    "hr": [
        (32, 0, 0), (48, 0, 1), (64, 0, 1),
        (16, 16, 0), (32, 16, 0), (48, 16, 1), (64, 16, 1), (80, 16, 1),
        (0, 32, 0), (16, 32, 0), (32, 32, 0), (48, 32, 1), (64, 32, 1), (80, 32, 1), (96, 32, 1),
        (0, 48, 0), (16, 48, 0), (32, 48, 0), (64, 48, 2), (80, 48, 2), (96, 48, 2),
        (0, 64, 3), (16, 64, 3), (32, 64, 3), (64, 64, 2), (80, 64, 2), (96, 64, 2),
        (16, 80, 3), (32, 80, 3), (64, 80, 2), (80, 80, 2),
        (32, 96, 3), (64, 96, 2),
    ],
}


def cuboid_place(kind: str, unit: Column, first: Column, second: Column) -> Column:
    """How a cuboid of ``kind`` stands: unit 0 reads the module's first index, unit 1 its second; null for other units and indices."""
    index = F.when(unit == 0, first).when(unit == 1, second).cast("int")
    constants = ((x + TURNS[turn][0][0], *TURNS[turn][0][1:], y + TURNS[turn][1][0], *TURNS[turn][1][1:]) for x, y, turn in CUBOIDS[kind])
    stands = ", ".join("named_struct(" + ", ".join(f"'{n}', {v}" for n, v in zip(("x0", "xx", "xy", "y0", "yx", "yy"), place)) + ")" for place in constants)
    return F.get(F.expr(f"array({stands})"), index)


def cuboid_at(kind: str, unit: Column, first: Column, second: Column, anode: Column, cathode: Column) -> Column:
    """Pixel in the cuboids of ``kind``, by cuboid_place."""
    place = cuboid_place(kind, unit, first, second)
    return F.when(place.isNotNull(), pixel2d(*turned_xy(*cuboid_cell(anode, cathode), cathode, place), 112, 112 * 32))


def pa_xy(sector: Column, anode: Column, cathode: Column) -> tuple[Column, Column]:
    counter, wire_ = cdt_parts(anode)
    return sector * 32 + 2 * (_high(anode, 5) + 4 * _high(cathode, 6)) + counter, _low(cathode, 5) * 16 + wire_


def pa(sector: Column, anode: Column, cathode: Column, nx: int, ny: int) -> Column:
    return pixel2d(*pa_xy(sector, anode, cathode), nx, ny)


# First pixel ids of the parts of two instruments.
PART_OFFSETS = {"fw_endcap": 0, "bw_endcap": 71680, "mantle": 229376, "sans": 720896, "hr": 1122304, "fr": 0, "pa": 245760}


def in_part(pixel: Column, part: str, compat: bool = False) -> Column:
    """Pixel id within the whole instrument. With ``compat`` an invalid pixel becomes the part's offset."""
    return (with_sentinel(pixel) if compat else pixel) + PART_OFFSETS[part]


# Beam monitors, Timepix, multigrid ----------------------------------------------------------------------------------------


def beam_monitor(kind: Column, x: Column, y: Column, width: Column, height: Column, offset: Column) -> Column:
    """2-D monitors (kind 2): the pixel plus its offset; 0-D monitors (kind 1): the offset; else 0."""
    flat = F.when((x >= 0) & (x < width) & (y >= 0) & (y < height), x + y * width + 1 + offset)
    return F.when(kind == 2, flat).when(kind == 1, offset).otherwise(0).cast("long")


# Units of the pixel clock and of the trigger clock in nanoseconds, and the time after which they wrap.
SPIDR_NS, TOA_NS, FTOA_NS, WRAP_NS = 409_600, 25, 1.5625, 26_843_545_600


def timepix_xy(dcol: Column, spix: Column, pix: Column) -> tuple[Column, Column]:
    return dcol + div(pix, 4), spix + pix.cast("int").bitwiseAND(3)


def timepix_clock(spidr: Column, toa: Column, ftoa: Column) -> Column:
    return (spidr * float(SPIDR_NS) + toa * float(TOA_NS) - ftoa * FTOA_NS).cast("long")


def tdc_clock(timestamp: Column, stamp: Column) -> Column:
    """(quarter, time): the trigger time and the number of wraps it passed."""
    ns = (timestamp * 3.125 + stamp * 0.26).cast("long")
    return F.struct(div(ns, WRAP_NS).alias("quarter"), (ns % WRAP_NS).alias("time"))


def multigrid(channel: Column, z_range: int, x_offset: int = 0, z_offset: int = 0, flip_x: int | None = None, flip_z: bool = False) -> tuple[Column, Column]:
    """(x, z) of a wire; ``flip_x`` is the number of columns if x counts down."""
    x, z = div(channel, z_range), channel % z_range
    return (flip_x - 1 - x if flip_x else x) + x_offset, (z_range - 1 - z if flip_z else z) + z_offset


# VMM3 --------------------------------------------------------------------------------------------------------------------


def vmm_hybrid(vmm: Column) -> Column:
    return F.shiftright(vmm.cast("int"), 1)


def vmm_asic(vmm: Column) -> Column:
    return vmm % 2


def adc10(otadc: Column) -> Column:
    return otadc.cast("int").bitwiseAND(0x3FF)


def tdc_correction(tdc: Column, offset: Column, slope: Column) -> Column:
    """Nanoseconds to add to a hit's time."""
    return (F.lit(1.5 * 22.72) - F.lit(60.0) * tdc / F.lit(255.0) - offset) * slope


def adc_correction(adc: Column, offset: Column, slope: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1023.0), (adc - offset) * slope)).cast("int")


def next_power_of_two(n: Column) -> Column:
    return F.when(n <= 1, F.lit(1).cast("long")).otherwise(F.pow(F.lit(2.0), F.ceil(F.log2(n.cast("double")))).cast("long"))
