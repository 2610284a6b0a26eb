"""SQL that expects the rows of the queries, for an engine that shares nothing with Spark."""

from __future__ import annotations

from ..functions import fixed
from ..operators import stencil
from ..operators.jpeg import fdct_matrix

_C1 = """h AS (SELECT (count(*) // 2) - (count(*) // 2) % 16 AS h FROM embeddings),
c1 AS (SELECT CAST(vec_id // 2 AS INT) AS y, CAST((vec_id % 2) * 64 + pos - 1 AS INT) AS x, CAST(greatest(0, least(1023, floor((e::DOUBLE + 1) * 511.5))) AS INT) AS v
    FROM (SELECT vec_id, unnest(embedding) AS e, generate_subscripts(embedding, 1) AS pos FROM embeddings) WHERE vec_id // 2 < (SELECT h FROM h))"""
_C1S = """c1s AS (SELECT y, x, CAST(greatest(0, least(1023, floor((v - 512) / 16.0) + 200 + CASE WHEN x >= 40 AND x < 90 THEN 300 ELSE 0 END
    + 150 * ((y // 24) % 2) + 60 * (x % 2) * ((y // 40) % 2) + (x * y) % 97)) AS INT) AS v FROM c1)"""


def _balance(source: str) -> str:
    q = fixed.Q16
    gain = f"CASE WHEN y % 2 = 0 AND x % 2 = 0 THEN {q[0]} WHEN y % 2 = 1 AND x % 2 = 1 THEN {q[2]} ELSE {q[1]} END"
    return f"SELECT y, x, CAST(greatest(0, least(65535, (((v - 64)::BIGINT * {gain} + 32768) >> 16) + 1024)) AS INT) AS v FROM {source}"


_WB = f"WITH {_C1}, {_C1S}, wb AS ({_balance('c1s')})"


def _packed(table: str, key: str, text: str) -> str:
    """Whole texts as hexadecimal digits, filled with zeros to words of 8 bytes."""
    return f"""b AS (SELECT {key} AS row_id, lower(hex(encode({text}))) AS h FROM {table}),
t AS (SELECT row_id, h || repeat('0', ((16 - length(h) % 16) % 16)::INT) AS h FROM b)"""


def _unpack(table: str, key: str, text: str) -> str:
    byte = lambda k: f"strpos('0123456789abcdef', substr(h, 2 * ({k}) + 1, 1)) * 16 + strpos('0123456789abcdef', substr(h, 2 * ({k}) + 2, 1)) - 17"
    return f"""WITH {_packed(table, key, text)}, w AS (SELECT row_id, regexp_extract_all(h, '.{{16}}') AS words FROM t),
r AS (SELECT row_id, unnest(words) AS h, unnest(range(len(words))) AS word FROM w), s AS (SELECT row_id, h, word, unnest(range(6)) AS j FROM r)
SELECT row_id, CAST(word * 6 + j AS INT) AS i, CAST(((({byte('j * 10 // 8 + 1')}) * 256 + {byte('j * 10 // 8')}) >> (j * 10 % 8)) & 1023 AS INT) AS p FROM s"""


def _u32(at: int) -> str:
    return "+".join(f"(strpos('0123456789abcdef', substr(h, {2 * (at + k) + 1}, 1)) * 16 + strpos('0123456789abcdef', substr(h, {2 * (at + k) + 2}, 1)) - 17)::BIGINT * {256**k}" for k in range(4))


_HEADER = """WITH f AS (SELECT c_custkey AS k, c_custkey % 5 <> 0 AS ok, CASE WHEN c_custkey % 3 = 0 THEN 0 ELSE 65536 + c_custkey * 97 END AS r, 65536 + c_custkey * 131 AS b FROM customer),
g AS (SELECT k, CASE WHEN k % 2 = 0 AND k % 4 <> 0 THEN k + 70000 WHEN ok AND r > 0 THEN r ELSE 65536 END AS r, 65536::BIGINT AS g,
    CASE WHEN k % 2 = 0 AND k % 4 <> 0 THEN k + 90000 WHEN ok AND r > 0 THEN b ELSE 65536 END AS b FROM f)"""

_LSC = """cal AS (SELECT i, ch, gy, gx, (128 - ((CASE WHEN i = 'A' THEN 3 ELSE 2 END) + ch) * (gy - 3) * (gy - 3) - 2 * (gx - 4) * (gx - 4)) / 128.0::DOUBLE AS s
    FROM (SELECT unnest(['A', 'B']) AS i), (SELECT unnest(range(4)) AS ch), (SELECT unnest(range(7)) AS gy), (SELECT unnest(range(9)) AS gx))"""
_BLEND = f"""{_LSC},
b0 AS (SELECT ch, gy, gx, greatest(sum(s * 0.5::DOUBLE), 1e-3::DOUBLE) AS v FROM cal GROUP BY ALL),
m0 AS (SELECT ch, avg(1 / v) AS m FROM b0 GROUP BY ch), m1 AS (SELECT ch, m, avg(m) OVER () AS t FROM m0),
bl AS (SELECT ch, gy, gx, 1 / greatest(1 + (1 / v - 1) * CASE WHEN abs(m - 1) < 1e-4 THEN 1 ELSE (t - 1) / (m - 1) END, 1e-3::DOUBLE) AS s FROM b0 JOIN m1 USING (ch))"""
_CELL = """cells AS (SELECT gy, gx FROM (SELECT unnest(range(7)) AS gy), (SELECT unnest(range(9)) AS gx)),
mx AS (SELECT least(6, greatest(0, trunc(y * (6 / ((SELECT h FROM h) - 1)::DOUBLE) + 0.5)))::INT AS gy, least(8, greatest(0, trunc(x * (8 / 127::DOUBLE) + 0.5)))::INT AS gx, max(v) AS m
    FROM c1 WHERE y % 8 = 0 AND x % 8 = 0 GROUP BY ALL),
cm AS (SELECT c.gy::INT AS gy, c.gx::INT AS gx, coalesce(m, 0) AS cell_max FROM cells c LEFT JOIN mx USING (gy, gx))"""
_FADE = f"""{_BLEND}, {_CELL},
room AS (SELECT gy, gx, 1 / s AS full_gain, cell_max - 64 AS mx, CASE WHEN cell_max > 64 THEN 0.85::DOUBLE * 959 / ((cell_max - 64) * (CASE ch WHEN 0 THEN 1.65::DOUBLE WHEN 3 THEN 2.08::DOUBLE ELSE 1 END)) END AS r FROM bl JOIN cm USING (gy, gx)),
fd AS (SELECT gy::INT AS gy, gx::INT AS gx, 1 - min(CASE WHEN mx <= 0 THEN 1 WHEN r >= full_gain THEN 1 WHEN r <= 1 THEN 0 ELSE (r - 1) / (full_gain - 1) END) AS fade FROM room GROUP BY ALL)"""
_SMOOTH = f"""{_FADE},
f1 AS (SELECT gy, gx, (coalesce(lag(fade) OVER w, fade) + fade * 2 + coalesce(lead(fade) OVER w, fade)) * 0.25::DOUBLE AS fade FROM fd WINDOW w AS (PARTITION BY gy ORDER BY gx)),
f2 AS (SELECT gy, gx, (coalesce(lag(fade) OVER w, fade) + fade * 2 + coalesce(lead(fade) OVER w, fade)) * 0.25::DOUBLE AS fade FROM f1 WINDOW w AS (PARTITION BY gx ORDER BY gy))"""

_HAD = f"""{_WB},
q AS (SELECT y // 2 AS j, x // 2 AS i, sum(CASE WHEN y % 2 = 0 AND x % 2 = 0 THEN v END)::DOUBLE AS r, sum(CASE WHEN y % 2 = 0 AND x % 2 = 1 THEN v END)::DOUBLE AS g,
    sum(CASE WHEN y % 2 = 1 AND x % 2 = 0 THEN v END)::DOUBLE AS k, sum(CASE WHEN y % 2 = 1 AND x % 2 = 1 THEN v END)::DOUBLE AS b FROM wb GROUP BY ALL),
had AS (SELECT 'Y' AS chan, j, i, (r + g + k + b) * 0.5::DOUBLE AS c FROM q UNION ALL SELECT 'CH', j, i, (r - g + k - b) * 0.5::DOUBLE FROM q
    UNION ALL SELECT 'CV', j, i, (r + g - k - b) * 0.5::DOUBLE FROM q UNION ALL SELECT 'CD', j, i, (r - g - k + b) * 0.5::DOUBLE FROM q)"""


def _haar(source: str, lvl: int) -> str:
    corner = lambda a, b: f"sum(CASE WHEN j % 2 = {a} AND i % 2 = {b} THEN c END)"
    bands = {"LL": "a + b + c + d", "HL": "a - b + c - d", "LH": "a + b - c - d", "HH": "a - b - c + d"}
    parts = " UNION ALL ".join(f"SELECT chan, {lvl} AS lvl, '{k}' AS band, j, i, ({e}) * 0.5::DOUBLE AS c FROM q{lvl}" for k, e in bands.items())
    return f"q{lvl} AS (SELECT chan, j // 2 AS j, i // 2 AS i, {corner(0, 0)} AS a, {corner(0, 1)} AS b, {corner(1, 0)} AS c, {corner(1, 1)} AS d FROM {source} GROUP BY chan, j // 2, i // 2), l{lvl} AS ({parts})"


_BANDS = f"""{_HAD}, {_haar('had', 1)}, {_haar("(SELECT * FROM l1 WHERE band = 'LL')", 2)}, {_haar("(SELECT * FROM l2 WHERE band = 'LL')", 3)},
bands AS (SELECT * FROM l1 WHERE band <> 'LL' UNION ALL SELECT * FROM l2 WHERE band <> 'LL' UNION ALL SELECT * FROM l3),
sg AS (SELECT chan, CASE WHEN count(*) >= 100 THEN quantile_disc(abs(c), 0.5 ORDER BY abs(c) DESC) / 0.6745::DOUBLE ELSE 0 END AS sigma FROM bands WHERE lvl = 1 AND band = 'HH' GROUP BY chan),
sd AS (SELECT chan, lvl, band, sqrt(greatest(avg(c * c) - avg(c) * avg(c), 0)) AS sd FROM bands WHERE band <> 'LL' GROUP BY ALL),
th AS (SELECT chan, lvl, band, CASE WHEN sigma <= 0 THEN NULL WHEN sd * sd - sigma * sigma <= 0 THEN -1
    ELSE sigma * sigma / sqrt(sd * sd - sigma * sigma) * (CASE chan WHEN 'Y' THEN 1 WHEN 'CD' THEN 5 ELSE 2.5::DOUBLE END) END AS t FROM sd JOIN sg USING (chan))"""


def _unhaar(lvl: int, low: str) -> str:
    parts = " UNION ALL ".join(f"SELECT chan, j * 2 + {a} AS j, i * 2 + {b} AS i, ({e}) * 0.5::DOUBLE AS c FROM w{lvl}" for a, b, e in ((0, 0, "ll + hl + lh + hh"), (0, 1, "ll - hl + lh - hh"), (1, 0, "ll + hl - lh - hh"), (1, 1, "ll - hl - lh + hh")))
    pick = ", ".join(f"sum(CASE WHEN band = '{b}' THEN c END) AS {b.lower()}" for b in ("LL", "HL", "LH", "HH"))
    return f"""w{lvl} AS (SELECT chan, j, i, {pick} FROM (SELECT chan, band, j, i, c FROM sh WHERE lvl = {lvl} AND band <> 'LL' UNION ALL SELECT chan, 'LL', j, i, c FROM {low}) GROUP BY chan, j, i),
u{lvl} AS ({parts})"""


_NR = f"""{_BANDS},
sh AS (SELECT chan, lvl, band, j, i, CASE WHEN band = 'LL' OR t IS NULL THEN c WHEN t < 0 THEN 0 ELSE sign(c) * greatest(abs(c) - t, 0) END AS c FROM bands LEFT JOIN th USING (chan, lvl, band)),
{_unhaar(3, "(SELECT * FROM sh WHERE lvl = 3 AND band = 'LL')")}, {_unhaar(2, 'u3')}, {_unhaar(1, 'u2')},
hp AS (SELECT j, i, sum(CASE WHEN chan = 'Y' THEN c END) AS a, sum(CASE WHEN chan = 'CH' THEN c END) AS h, sum(CASE WHEN chan = 'CV' THEN c END) AS v, sum(CASE WHEN chan = 'CD' THEN c END) AS d FROM u1 GROUP BY ALL),
nr AS ({" UNION ALL ".join(f"SELECT CAST(j * 2 + {p} AS INT) AS y, CAST(i * 2 + {q} AS INT) AS x, CAST(floor(greatest(0, least(65535, ({e}) * 0.5::DOUBLE)) + 0.5) AS INT) AS v FROM hp" for p, q, e in ((0, 0, "a + h + v + d"), (0, 1, "a - h + v - d"), (1, 0, "a + h - v - d"), (1, 1, "a - h - v + d")))})"""


def _rows(source: str, reach: int, value: str = "v") -> str:
    """Rows as lists with the rows around them, edges repeated."""
    near = ", ".join(f"coalesce({', '.join(f'{step}(r, {n}) OVER w' for n in range(k, 0, -1))}, r) AS r{s}{k}" for s, step in (("m", "lag"), ("", "lead")) for k in range(1, reach + 1))
    return f"rl AS (SELECT y, list({value} ORDER BY x) AS r FROM {source} GROUP BY y), rn AS (SELECT y, r AS r0, {near}, unnest(range(128)) AS x FROM rl WINDOW w AS (ORDER BY y))"


def _at(dy: int, dx: int) -> str:
    return f"r{dy}[least(127, greatest(0, x + {dx})) + 1]".replace("r-", "rm")


def _conv(kernel: dict[tuple[int, int], int]) -> str:
    return "greatest((" + " + ".join(f"{w} * {_at(dy, dx)}" for (dy, dx), w in kernel.items()) + ") >> 4, 0)"


def _by_parity(options: tuple[str, str, str, str]) -> str:
    return f"CASE (y % 2) * 2 + x % 2 WHEN 0 THEN {options[0]} WHEN 1 THEN {options[1]} WHEN 2 THEN {options[2]} ELSE {options[3]} END"


def _bilinear() -> dict[str, str]:
    mean = lambda *c: f"(({' + '.join(c)}) >> {len(c) // 2})"
    own, row, column = _at(0, 0), mean(_at(0, -1), _at(0, 1)), mean(_at(-1, 0), _at(1, 0))
    four, cross = mean(_at(-1, 0), _at(1, 0), _at(0, -1), _at(0, 1)), mean(_at(-1, -1), _at(-1, 1), _at(1, -1), _at(1, 1))
    return {"r": _by_parity((own, row, column, cross)), "g": _by_parity((four, own, own, four)), "b": _by_parity((cross, column, row, own))}


def _mhc(source: str) -> str:
    row = f"CASE WHEN way = 'h' THEN {_conv(fixed.ALONG_ROW)} ELSE {_conv(fixed.HORIZ)} END"
    column = f"CASE WHEN way = 'v' THEN {_conv(fixed.ALONG_COLUMN)} ELSE {_conv(fixed.VERT)} END"
    green = f"CASE way WHEN 'h' THEN {_conv(fixed.ALONG_ROW)} WHEN 'v' THEN {_conv(fixed.ALONG_COLUMN)} ELSE {_conv(fixed.G_AT_RB)} END"
    own, cross, plain = _at(0, 0), _conv(fixed.DIAG), _bilinear()
    inner = {"r": _by_parity((own, row, column, cross)), "g": _by_parity((green, own, own, green)), "b": _by_parity((cross, column, row, own))}
    border = "y < 2 OR y >= (SELECT h FROM h) - 2 OR x < 2 OR x >= 126"
    out = ", ".join(f"CAST(CASE WHEN {border} THEN {plain[c]} ELSE {inner[c]} END AS INT) AS {c}" for c in "rgb")
    h = f"abs({_at(0, -1)} - {_at(0, 1)}) + abs({_at(0, -2)} - {_at(0, 2)})"
    v = f"abs({_at(-1, 0)} - {_at(1, 0)}) + abs({_at(-2, 0)} - {_at(2, 0)})"
    return f"{_rows(source, 2)}, dg AS (SELECT *, {h} AS hg, {v} AS vg FROM rn), dw AS (SELECT *, CASE WHEN abs(hg - vg) <= 64 THEN 'n' WHEN hg < vg THEN 'h' ELSE 'v' END AS way FROM dg), mhc AS (SELECT y, CAST(x AS INT) AS x, {out} FROM dw)"


_PLAIN = f"{_WB}, {_rows('wb', 1)}, bi AS (SELECT y, CAST(x AS INT) AS x, {', '.join(f'CAST({e} AS INT) AS {c}' for c, e in _bilinear().items())} FROM rn)"


def _d(x: float) -> str:
    return f"{x!r}::DOUBLE"


def _linear(source: str) -> str:
    unit = ", ".join(f"least(1, greatest(0, greatest({c} - 1024, 0) * {_d(1.0 / 959)})) AS {c}" for c in "rgb")
    matrix = ", ".join("r * {} + g * {} + b * {} AS {}".format(*map(_d, m), c) for c, m in zip("rgb", fixed.CAM_TO_SRGB, strict=True))
    return f"nm AS (SELECT y, x, {unit} FROM {source}), cm3 AS (SELECT y, x, {matrix} FROM nm)"


_Y = "(r * {} + g * {} + b * {})".format(*map(_d, fixed.LUMA709))


def _exposed(source: str) -> str:
    point = lambda i: f"(1.5::DOUBLE / (1 + 0.5::DOUBLE * (({i}) * {_d(2.0 / 1024)})))"
    return f"""e0 AS (SELECT *, {_Y} AS yy FROM {source}), e1 AS (SELECT *, greatest(0, least(1022, floor(yy * 512))) AS ii, CASE WHEN floor(yy * 512) > 1022 THEN 1 ELSE yy * 512 - greatest(0, least(1022, floor(yy * 512))) END AS ff FROM e0),
e2 AS (SELECT y, x, r, g, b, CASE WHEN yy > 1e-6 THEN {point('ii')} + ({point('ii + 1')} - {point('ii')}) * ff ELSE 1.5::DOUBLE END AS ra FROM e1), ex AS (SELECT y, x, r * ra AS r, g * ra AS g, b * ra AS b FROM e2)"""


def _saturated(source: str) -> str:
    lift = ", ".join(f"{c} - 0.02::DOUBLE AS {c}" for c in "rgb")
    return f"bk AS (SELECT y, x, {lift} FROM {source}), bk2 AS (SELECT *, {_Y} AS yy FROM bk), sat AS (SELECT y, x, {', '.join(f'yy + ({c} - yy) * 1.4::DOUBLE AS {c}' for c in 'rgb')} FROM bk2)"


def _tone(c: str) -> str:
    lin = f"(trunc(greatest(0, least(16383, ({c}) * 16383::DOUBLE))) / 16383::DOUBLE)"
    toned = f"greatest(0, least(1, {lin} * {_d(1 - fixed.TONE)} + {lin} * {lin} * (3 - 2 * {lin}) * {_d(fixed.TONE)}))"
    return f"CAST(trunc(greatest(0, least(255, pow({toned}, {_d(1 / 2.2)}) * 255 + 0.5))) AS INT)"


_RGB8 = f"{_PLAIN}, rgb AS (SELECT y, x, r % 256 AS r, g % 256 AS g, b % 256 AS b FROM bi)"
_LUMA = "((217 * r + 732 * g + 74 * b + 512) >> 10)"
_TAPS = stencil.gauss(fixed.RADIUS)
_N = len(_TAPS) // 2


def _blur_h(source: str, value: str) -> str:
    total = " + ".join(f"r[least(127, greatest(0, x + {k - _N})) + 1] * {_d(t)}" for k, t in enumerate(_TAPS))
    return f"bh0 AS (SELECT y, list({value} ORDER BY x) AS r FROM {source} GROUP BY y), bh1 AS (SELECT y, r, unnest(range(128)) AS x FROM bh0), bh AS (SELECT y, CAST(x AS INT) AS x, CAST(round_even({total}, 0) AS INT) AS v FROM bh1)"


def _blur_v(source: str, value: str) -> str:
    total = " + ".join(f"{f'r{k - _N}'.replace('r-', 'rm')}[x + 1] * {_d(t)}" for k, t in enumerate(_TAPS))
    near = ", ".join(f"coalesce({', '.join(f'{step}(r, {n}) OVER w' for n in range(k, 0, -1))}, r) AS r{s}{k}" for s, step in (("m", "lag"), ("", "lead")) for k in range(1, _N + 1))
    return f"vl AS (SELECT y, list({value} ORDER BY x) AS r FROM {source} GROUP BY y), vn AS (SELECT y, r AS r0, {near}, unnest(range(128)) AS x FROM vl WINDOW w AS (ORDER BY y)), bv AS (SELECT y, CAST(x AS INT) AS x, CAST(round_even({total}, 0) AS INT) AS v FROM vn)"


def _sharp(source: str) -> str:
    return f"""{_blur_h(source, _LUMA)}, {_blur_v('bh', 'v')},
s0 AS (SELECT s.*, {_LUMA} - bv.v AS d FROM {source} s JOIN bv USING (y, x)),
s1 AS (SELECT *, CAST(round_even((CASE WHEN d > 3 THEN d - 3 WHEN d < -3 THEN d + 3 ELSE 0 END) * 0.8::DOUBLE, 0) AS INT) AS dl FROM s0),
s2 AS (SELECT *, CASE WHEN dl > 0 THEN least(dl, 255 - greatest(r, g, b)) ELSE greatest(dl, -least(r, g, b)) END AS st FROM s1),
sharp AS (SELECT y, x, CAST(r + st AS INT) AS r, CAST(g + st AS INT) AS g, CAST(b + st AS INT) AS b FROM s2)"""


_YCC = "(((19595 * r + 38470 * g + 7471 * b + 32768) >> 16) - 128)"


_WEIGHTS = "(VALUES " + ", ".join(f"({k}, {n}, {w})" for k, row in enumerate(fdct_matrix()) for n, w in enumerate(row)) + ") m(k, n, w)"
_DCT = f"""{_RGB8}, k0 AS (SELECT y // 8 AS ty, x // 8 AS tx, y % 8 AS u, x % 8 AS n, {_YCC}::BIGINT AS s FROM rgb),
k1 AS (SELECT ty, tx, u AS n, m.k AS w, (sum(s * m.w)::BIGINT + 1024) >> 11 AS t FROM k0 JOIN {_WEIGHTS} USING (n) GROUP BY ty, tx, u, m.k),
k2 AS (SELECT ty, tx, m.k AS u, k1.w AS w, (sum(t * m.w)::BIGINT + 16384) >> 15 AS c FROM k1 JOIN {_WEIGHTS} USING (n) GROUP BY ty, tx, m.k, k1.w),
dct AS (SELECT ty AS block_y, tx AS block_x, CAST(u AS INT) AS u, CAST(w AS INT) AS w, CAST(c AS INT) AS c FROM k2)"""
_SPOT = [fixed.ZIGZAG.index(i) for i in range(64)]
_QUANT = f"""{_DCT}, qt AS (SELECT list_transform({list(fixed.LUMA_TABLE)}, lambda t: 8 * least(255, greatest(1, (t * 50 + 50) // 100))) AS d),
qz AS (SELECT block_y, block_x, {_SPOT}[u * 8 + w + 1] AS k, CAST(sign(c) * ((abs(c) + d[u * 8 + w + 1] // 2) // d[u * 8 + w + 1]) AS INT) AS q FROM dct, qt)"""
_SIZE = "CASE WHEN {0} = 0 THEN 0 ELSE length(ltrim(bin(abs({0})), '0')) END"

# First coefficients only: both passes weigh all eight samples by 8192.  Steps at quality 75: 8 * 8 of luma, 8 * 9 of chroma.
_MCU_DC = f"""mean4 AS (SELECT y // 2 AS cy, x // 2 AS cx, (sum(r)::INT + 2) >> 2 AS r, (sum(g)::INT + 2) >> 2 AS g, (sum(b)::INT + 2) >> 2 AS b FROM rgb GROUP BY ALL),
chroma AS (SELECT cy, cx, greatest(0, least(255, (-11059 * r - 21709 * g + 32768 * b + 8421376) >> 16)) - 128 AS cb, greatest(0, least(255, (32768 * r - 27439 * g - 5329 * b + 8421376) >> 16)) - 128 AS cr FROM mean4),
samples AS (SELECT y // 16 AS my, x // 16 AS mx, (y % 16) // 8 * 2 + (x % 16) // 8 AS block, y % 8 AS u, {_YCC}::BIGINT AS s FROM rgb
    UNION ALL SELECT cy // 8, cx // 8, 4, cy % 8, cb FROM chroma UNION ALL SELECT cy // 8, cx // 8, 5, cy % 8, cr FROM chroma),
pass1 AS (SELECT my, mx, block, u, (sum(s)::BIGINT * 8192 + 1024) >> 11 AS t FROM samples GROUP BY ALL),
pass2 AS (SELECT my, mx, block, (sum(t)::BIGINT * 8192 + 16384) >> 15 AS c, CASE WHEN block < 4 THEN 64 ELSE 72 END AS d FROM pass1 GROUP BY ALL),
dcq AS (SELECT my, mx, block, CAST(sign(c) * ((abs(c) + d // 2) // d) AS INT) AS q FROM pass2)"""

_MESSAGES = "SELECT event_id AS seq, user_id AS peer, ts, CASE WHEN event_type = 'view' THEN '4a504731' ELSE '444e4731' END AS magic, lower(hex(encode(props))) AS body FROM events"
_LE32 = "printf('%02x%02x%02x%02x', (n % 256)::INT, ((n // 256) % 256)::INT, ((n // 65536) % 256)::INT, ((n // 16777216) % 256)::INT)"
_FRAMED = f"WITH m AS ({_MESSAGES}), n AS (SELECT *, CAST(length(body) // 2 AS BIGINT) AS n FROM m), f AS (SELECT *, magic || {_LE32} || body AS wire FROM n)"

_RGB_OUT = "SELECT y, x, round(r, 6) AS r, round(g, 6) AS g, round(b, 6) AS b FROM "

ORACLES: dict[str, str] = {
    "black_wb_stats": f"WITH {_C1}, wb AS ({_balance('c1')}) SELECT CAST((y % 2) * 2 + x % 2 AS INT) AS ch, count(*) AS n, CAST(sum(v) AS BIGINT) AS total, min(v) AS low, max(v) AS high FROM wb GROUP BY 1",
    "black_wb": f"WITH {_C1} {_balance('c1')}",
    "bayer_structured": f"WITH {_C1}, {_C1S} SELECT y, x, v FROM c1s",
    "unpack10_documents": _unpack("documents", "doc_id", "text"),
    "unpack10_pages": _unpack("pages", "page_id", "html"),
    "read_u32": f"WITH {_packed('documents', 'doc_id', 'text')} SELECT row_id, {', '.join(f'CASE WHEN length(h) >= {2 * a + 8} THEN {_u32(a)} END AS u{a}' for a in (0, 5, 44))} FROM t",
    "header_fields": f"{_HEADER} SELECT k AS frame_id, k % 5248 + 6 AS width, k % 3936 + 1 AS height, k * 37 % 500000 AS exposure_us, k * 211 % 40000 AS iso, 65536::BIGINT AS g, r::BIGINT AS r, b FROM f WHERE ok",
    "wb_gains": f"{_HEADER} SELECT k AS frame_id, r, g, b FROM g",
    "wb_ratio": f"{_HEADER} SELECT k AS frame_id, round(r / 65536::DOUBLE, 9) AS gain_r, round(b / 65536::DOUBLE, 9) AS gain_b, g AS neutral_num, r AS neutral_r_den, b AS neutral_b_den FROM g",
    "exif_fields": f"{_HEADER} SELECT k AS frame_id, CASE WHEN ok THEN k * 37 % 500000 ELSE 0 END AS exposure_us, CASE WHEN ok THEN least(k * 211 % 40000, 25600) ELSE 0 END AS iso, 2 AS fnum_n, 1 AS fnum_d, 49 AS focal_n, 10 AS focal_d FROM f",
    "lsc_parse": f"WITH {_LSC}, ok AS (SELECT count(*) AS n FROM customer WHERE c_custkey % 7 <> 0 AND c_custkey % 11 <> 0) SELECT i AS illum, CAST(ch AS INT) AS ch, CAST(gy AS INT) AS gy, CAST(gx AS INT) AS gx, n AS frames, s AS shading FROM cal, ok",
    "lsc_warmth": f"{_HEADER} SELECT k AS frame_id, round(CASE WHEN b <= 0 THEN 0 WHEN r / b::DOUBLE >= 1.1::DOUBLE THEN 0 WHEN r / b::DOUBLE <= 0.6::DOUBLE THEN 1 ELSE (1.1::DOUBLE - r / b::DOUBLE) / 0.5 END, 9) AS warmth FROM g",
    "lsc_blend": f"WITH {_BLEND} SELECT CAST(ch AS INT) AS ch, CAST(gy AS INT) AS gy, CAST(gx AS INT) AS gx, round(s, 9) AS shading FROM bl",
    "lsc_cell_max": f"WITH {_C1}, {_CELL} SELECT gy, gx, cell_max FROM cm",
    "lsc_safe_fraction": f"WITH {_C1}, {_FADE} SELECT gy, gx, round(fade, 9) AS fade FROM fd",
    "fade_smooth": f"WITH {_C1}, {_SMOOTH} SELECT gy, gx, round(fade, 9) AS fade FROM f2",
    "hadamard_fwd": f"{_HAD} SELECT chan, CAST(j AS INT) AS j, CAST(i AS INT) AS i, c FROM had",
    "hadamard_roundtrip": f"{_WB} SELECT y, x, v FROM wb",
    "haar_levels": f"{_BANDS} SELECT chan, CAST(lvl AS INT) AS lvl, band, CAST(j AS INT) AS j, CAST(i AS INT) AS i, round(c, 6) AS c FROM bands",
    "mad_sigma": f"{_BANDS} SELECT chan, round(sigma, 6) AS sigma FROM sg",
    "band_stddev": f"{_BANDS} SELECT chan, CAST(lvl AS INT) AS lvl, band, round(sd, 6) AS sd FROM sd",
    "bayes_shrink": f"{_BANDS} SELECT chan, CAST(lvl AS INT) AS lvl, band, round(t, 6) AS t FROM th",
    "bayer_nr": f"{_NR} SELECT y, x, v FROM nr",
    "demosaic_border": f"{_PLAIN} SELECT y, x, r, g, b FROM bi",
    "demosaic_mhc": f"{_WB}, {_mhc('wb')} SELECT y, x, r, g, b FROM mhc",
    "color_matrix": f"{_PLAIN}, {_linear('bi')} {_RGB_OUT} cm3",
    "exposure": f"{_PLAIN}, {_linear('bi')}, {_exposed('cm3')} {_RGB_OUT} ex",
    "saturation": f"{_PLAIN}, {_linear('bi')}, {_saturated('cm3')} {_RGB_OUT} sat",
    "tone_gamma": f"SELECT c_custkey, {_tone('c')} AS r, {_tone('c * 0.5::DOUBLE')} AS g, {_tone('1 - c')} AS b FROM (SELECT c_custkey, c_custkey % 16384 / 16383::DOUBLE AS c FROM customer)",
    "luma709_fixed": f"{_RGB8} SELECT y, x, CAST({_LUMA} AS INT) AS luma FROM rgb",
    "blur_h": f"{_RGB8}, {_blur_h('rgb', _LUMA)} SELECT y, x, v FROM bh",
    "blur_v": f"{_RGB8}, {_blur_v('rgb', _LUMA)} SELECT y, x, v FROM bv",
    "unsharp": f"{_RGB8}, {_sharp('rgb')} SELECT y, x, r, g, b FROM sharp",
    "rgb_to_ycc": f"{_RGB8} SELECT y, x, CAST({_YCC} AS INT) AS luma FROM rgb",
    "chroma_420": f"{_RGB8}, m4 AS (SELECT y // 2 AS cy, x // 2 AS cx, (sum(r)::INT + 2) >> 2 AS r, (sum(g)::INT + 2) >> 2 AS g, (sum(b)::INT + 2) >> 2 AS b FROM rgb GROUP BY ALL) SELECT CAST(cy AS INT) AS cy, CAST(cx AS INT) AS cx, CAST(greatest(0, least(255, (-11059 * r - 21709 * g + 32768 * b + 8421376) >> 16)) - 128 AS INT) AS cb, CAST(greatest(0, least(255, (32768 * r - 27439 * g - 5329 * b + 8421376) >> 16)) - 128 AS INT) AS cr FROM m4",
    "quality_table": f"WITH t AS (SELECT {list(fixed.LUMA_TABLE)} AS t), q AS (SELECT unnest([1, 25, 50, 75, 96, 100]) AS q), s AS (SELECT q, CASE WHEN q < 50 THEN 5000 // q ELSE 200 - 2 * q END AS s, t, unnest(range(64)) AS p FROM q, t) SELECT CAST(q AS INT) AS quality, CAST(p AS INT) AS place, CAST(least(255, greatest(1, (t[p + 1] * s + 50) // 100)) AS INT) AS step FROM s",
    "huff_table": f"WITH b AS (SELECT unnest(range(1, 17)) AS l, unnest({list(fixed.DC_LUMA[0])}) AS n), c AS (SELECT l, n, (SELECT coalesce(sum(x.n * (1 << (b.l - x.l))), 0) FROM b x WHERE x.l < b.l)::INT AS first, (SELECT coalesce(sum(x.n), 0) FROM b x WHERE x.l < b.l)::INT AS s FROM b), e AS (SELECT *, unnest(range(n)) AS k FROM c WHERE n > 0) SELECT CAST(s + k AS INT) AS symbol, CAST(first + k AS INT) AS code, CAST(l AS INT) AS len FROM e",
    "fdct8x8": f"{_DCT} SELECT CAST(block_y AS INT) AS block_y, CAST(block_x AS INT) AS block_x, u, w, c FROM dct",
    "quantize_zigzag": f"{_QUANT} SELECT CAST(block_y AS INT) AS block_y, CAST(block_x AS INT) AS block_x, k, q FROM qz",
    "dc_delta": f"""{_RGB8}, {_MCU_DC}, dd AS (SELECT my, mx, block, q - coalesce(lag(q) OVER (PARTITION BY greatest(block - 3, 0) ORDER BY my, mx, block), 0) AS diff FROM dcq)
SELECT CAST(my AS INT) AS my, CAST(mx AS INT) AS mx, CAST(block AS INT) AS block, CAST(diff AS INT) AS diff, CAST({_SIZE.format('diff')} AS INT) AS size FROM dd""",
    "ac_rle": f"{_QUANT}, nz AS (SELECT block_y, block_x, k, q, k - coalesce(lag(k) OVER (PARTITION BY block_y, block_x ORDER BY k), 0) - 1 AS run FROM qz WHERE k > 0 AND q <> 0), eb AS (SELECT block_y, block_x FROM qz GROUP BY block_y, block_x HAVING coalesce(max(CASE WHEN k > 0 AND q <> 0 THEN k END), 0) < 63) SELECT CAST(block_y AS INT) AS block_y, CAST(block_x AS INT) AS block_x, CAST(k AS INT) AS k, CAST(run % 16 AS INT) AS run, CAST({_SIZE.format('q')} AS INT) AS size, CAST(run // 16 AS INT) AS zrls FROM nz UNION ALL SELECT CAST(block_y AS INT), CAST(block_x AS INT), 64, 0, 0, 0 FROM eb",
    "frame_messages": f"{_FRAMED} SELECT seq, n AS body_len, wire FROM f",
    "message_chunks": f"{_FRAMED}, c AS (SELECT seq, wire, unnest(range((length(wire) // 2 - 1) // 16 + 1)) AS chunk FROM f) SELECT seq, CAST(chunk AS INT) AS chunk, substr(wire, chunk * 32 + 1, 32) AS data FROM c",
    "sink_route": "WITH m AS (SELECT event_id AS seq, user_id % 3 = 0 AS peer, CASE WHEN event_id % 4 <> 0 THEN 'out.d/f' || event_id || CASE WHEN event_id % 2 = 0 THEN '.dng' ELSE '' END END AS path FROM events) SELECT seq, CASE WHEN peer THEN 'stream' WHEN path IS NOT NULL THEN 'file' ELSE 'noop' END AS sink, CASE WHEN path IS NOT NULL THEN 'out.d/f' || seq || '.jpg' END AS jpeg FROM m",
    "dng_strip": f"WITH {_C1} SELECT y AS part, string_agg(printf('%02x%02x', v % 256, v // 256), '' ORDER BY x) AS data FROM c1 GROUP BY y",
    "has_peer": """WITH m AS (SELECT event_id % 7 AS endpoint, ts, event_id AS seq, user_id % 5 AS peer, event_type <> 'purchase' AS open FROM events WHERE user_id * 37 % 14000 + 8000 BETWEEN 10000 AND 19999),
n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY endpoint ORDER BY ts DESC, seq DESC) AS k FROM m WHERE open) WHERE k = 1),
s AS (SELECT endpoint, EXISTS (SELECT 1 FROM m WHERE NOT m.open AND m.endpoint = n.endpoint AND m.peer = n.peer AND (m.ts, m.seq) > (n.ts, n.seq)) AS gone, peer FROM n)
SELECT e.endpoint, CASE WHEN NOT gone THEN peer END AS peer, coalesce(NOT gone, false) AS has_peer FROM (SELECT DISTINCT endpoint FROM m) e LEFT JOIN s USING (endpoint)""",
    "shot_datetime": "SELECT event_id, strftime(ts, '%Y:%m:%d %H:%M:%S') AS datetime FROM events",
    "peer_latest": "SELECT arg_max(user_id, (ts, event_id)) AS peer, max(ts) AS since, count(*) AS connections FROM events",
}


def _place(at: str, size: str, cells: int) -> tuple[str, str]:
    g = f"(({at}) * ({cells - 1} / {size}::DOUBLE))"
    i = f"least({cells - 2}, greatest(0, trunc({g})))::INT"
    return i, f"least(1, greatest(0, {g} - {i}))"


def _shaded(source: str) -> str:
    """Black level, shading and white balance of a plane."""
    (y0, fy), (x0, fx) = _place("y", "((SELECT h FROM h) - 1)", 7), _place("x", "127", 9)
    (ty, gy), (tx, gx) = _place("y - y % 2", "((SELECT h FROM h) - 1)", 7), _place("x - x % 2", "127", 9)
    cell = lambda a, b: f"sa[((y % 2) * 2 + x % 2) * 63 + (y0 + {a}) * 9 + x0 + {b} + 1]"
    side = lambda b: f"({cell(0, b)} * (1 - fy) + {cell(1, b)} * fy)"
    fade = lambda a: f"(fa[(ty + {a}) * 9 + tx + 1] * (1 - gx) + fa[(ty + {a}) * 9 + tx + 2] * gx)"
    q = fixed.Q16
    colour = f"CASE WHEN y % 2 = 0 AND x % 2 = 0 THEN {q[0]} WHEN y % 2 = 1 AND x % 2 = 1 THEN {q[2]} ELSE {q[1]} END"
    return f"""{_SMOOTH}, ar AS (SELECT (SELECT list(s ORDER BY ch, gy, gx) FROM bl) AS sa, (SELECT list(fade ORDER BY gy, gx) FROM f2) AS fa),
g0 AS (SELECT y, x, v, sa, fa, {y0} AS y0, {fy} AS fy, {x0} AS x0, {fx} AS fx, {ty} AS ty, {gy} AS gy, {tx} AS tx, {gx} AS gx FROM {source}, ar),
g1 AS (SELECT y, x, v - 64 AS v, 1 + (1 / ({side(0)} * (1 - fx) + {side(1)} * fx) - 1) * (1 - least(1, greatest(0, {fade(0)} * (1 - gy) + {fade(1)} * gy))) AS gain FROM g0),
g2 AS (SELECT y, x, CASE WHEN gain = 1 THEN v WHEN v * gain >= 0 THEN floor(v * gain + 0.5) ELSE ceil(v * gain - 0.5) END::BIGINT AS v FROM g1),
shaded AS (SELECT y, x, CAST(greatest(0, least(65535, ((v * {colour} + 32768) >> 16) + 1024)) AS INT) AS v FROM g2)"""


ORACLES["black_wb_lsc"] = f"WITH {_C1}, {_shaded('c1')} SELECT y, x, v FROM shaded"
