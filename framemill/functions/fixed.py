"""Sensor constants, kernels, matrices and tables of the camera and of the JPEG and TIFF formats."""

from __future__ import annotations

BLACK, WHITE, PEDESTAL = 64, 959, 1024
#: White-balance gains of the fixtures, and the same in Q16.
GAINS = (1.65, 1.0, 2.08)
Q16 = tuple(int(g * 65536 + 0.5) for g in GAINS)
#: Camera to linear sRGB, row by row.
CAM_TO_SRGB = ((1.912046, -0.890579, -0.033183), (-0.133173, 1.393261, -0.256702), (0.101192, -0.707967, 1.610468))
LUMA709 = (0.2126, 0.7152, 0.0722)
#: Look of the deployed pipeline: exposure, black lift, saturation, tone contrast; amount, radius and threshold of sharpening.
EXPOSURE, LIFT, SATURATION, TONE = 1.5, 0.02, 1.4, 0.4
AMOUNT, RADIUS, THRESHOLD = 0.8, 3.0, 3
SAFE_SHARE = 0.85
#: Strength of noise reduction by Hadamard plane.
PLANES = {"Y": 1.0, "CH": 2.5, "CV": 2.5, "CD": 5.0}

#: Demosaic kernels as (dy, dx): weight; each sums to 16.
G_AT_RB = {(-2, 0): -2, (-1, 0): 4, (0, -2): -2, (0, -1): 4, (0, 0): 8, (0, 1): 4, (0, 2): -2, (1, 0): 4, (2, 0): -2}
HORIZ = {(-2, 0): 1, (-1, -1): -2, (-1, 1): -2, (0, -2): -2, (0, -1): 8, (0, 0): 10, (0, 1): 8, (0, 2): -2, (1, -1): -2, (1, 1): -2, (2, 0): 1}
VERT = {(dx, dy): w for (dy, dx), w in HORIZ.items()}
DIAG = {(-2, 0): -3, (-1, -1): 4, (-1, 1): 4, (0, -2): -3, (0, 0): 12, (0, 2): -3, (1, -1): 4, (1, 1): 4, (2, 0): -3}
ALONG_ROW = {(0, -2): -4, (0, -1): 8, (0, 0): 8, (0, 1): 8, (0, 2): -4}
ALONG_COLUMN = {(dx, dy): w for (dy, dx), w in ALONG_ROW.items()}
DIRECTION_THRESHOLD = 64

#: JPEG (ITU T.81 Annex K) quantisation tables, row by row, and the zigzag order of a block.
LUMA_TABLE = (
    16, 11, 10, 16, 24, 40, 51, 61, 12, 12, 14, 19, 26, 58, 60, 55, 14, 13, 16, 24, 40, 57, 69, 56, 14, 17, 22, 29, 51, 87, 80, 62,
    18, 22, 37, 56, 68, 109, 103, 77, 24, 35, 55, 64, 81, 104, 113, 92, 49, 64, 78, 87, 103, 121, 120, 101, 72, 92, 95, 98, 112, 100, 103, 99,
)
CHROMA_TABLE = (
    17, 18, 24, 47, 99, 99, 99, 99, 18, 21, 26, 66, 99, 99, 99, 99, 24, 26, 56, 99, 99, 99, 99, 99, 47, 66, 99, 99, 99, 99, 99, 99,
    99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99,
)
ZIGZAG = tuple(sorted(range(64), key=lambda i: (i // 8 + i % 8, i // 8 if (i // 8 + i % 8) % 2 else i % 8)))
#: Huffman codes by length 1..16 and the symbols in order, of the DC tables.
DC_LUMA = ((0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0), tuple(range(12)))
DC_CHROMA = ((0, 3, 1, 1, 1, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0), tuple(range(12)))
#: The same of the AC tables; a symbol is a run of zeros times 16 plus a size in bits.
AC_LUMA = (
    (0, 2, 1, 3, 3, 2, 4, 3, 5, 5, 4, 4, 0, 0, 1, 125),
    tuple(bytes.fromhex(
        "01020300041105122131410613516107227114328191a1082342b1c11552d1f02433627282090a161718191a25262728292a3435363738393a434445464748494a535455565758595a636465666768696a"
        "737475767778797a838485868788898a92939495969798999aa2a3a4a5a6a7a8a9aab2b3b4b5b6b7b8b9bac2c3c4c5c6c7c8c9cad2d3d4d5d6d7d8d9dae1e2e3e4e5e6e7e8e9eaf1f2f3f4f5f6f7f8f9fa"
    )),
)
AC_CHROMA = (
    (0, 2, 1, 2, 4, 4, 3, 4, 7, 5, 4, 4, 0, 1, 2, 119),
    tuple(bytes.fromhex(
        "000102031104052131061241510761711322328108144291a1b1c109233352f0156272d10a162434e125f11718191a262728292a35363738393a434445464748494a535455565758595a63646566676869"
        "6a737475767778797a82838485868788898a92939495969798999aa2a3a4a5a6a7a8a9aab2b3b4b5b6b7b8b9bac2c3c4c5c6c7c8c9cad2d3d4d5d6d7d8d9dae2e3e4e5e6e7e8e9eaf2f3f4f5f6f7f8f9fa"
    )),
)

RAW_HEADER = 3272
RAW_MAGIC = b"RAW\0"
WB_MAGIC = 0x4257
#: Byte offsets of the fields of a RAW header.
HEADER = {"width": 0x0C, "height": 0x10, "exposure_us": 0x20, "iso": 0x24, "g": 0x30, "r": 0x38, "b": 0x54}
LSC_OFFSET, LSC_STRIDE, LSC_CELLS = 0x5C8, 64, 63
GRID_H, GRID_W = 7, 9

#: 13-bit constants of the accurate integer DCT: of the even part, of each odd difference, of the odd pairs (negative), shared.
DCT_EVEN = (4433, 6270, 15137)
DCT_OWN = (2446, 16819, 25172, 12299)
DCT_PAIRS = (7373, 20995, 16069, 3196)
DCT_SHARED = 9633
