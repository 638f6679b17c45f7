import math

import pytest
from pyspark.sql import functions as F

from millrace.functions.media import MediaPlugin, get_plugin, plugins, register_plugin, repeated

MEDIUM = "struct<width:int,height:int,frames:int,seconds:double>"


def filled(spark, name, content, **media):
    kinds = {k: f"array<{MEDIUM}>" for k in media}
    df = spark.createDataFrame([(content, *media.values())], ", ".join(["c string", *(f"{k} {t}" for k, t in kinds.items())]))
    return df.select(get_plugin(name).expanded("c", **{k: F.col(k) for k in media})).first()[0]


def test_tokens_stand_where_placeholders_stood(spark):
    one, two = (28, 56, None, None), (560, 560, None, None)
    got = filled(spark, "qwen2_vl", "a <image> b <image>.", images=[one, two])
    head, tail = "<|vision_start|>", "<|vision_end|>"
    assert got.startswith(f"a {head}") and got.endswith(f"{tail}.") and got.count(head) == 2
    first, second = got.split(" b ")
    assert second.count("<|image_pad|>") == 400 and first.count("<|image_pad|>") == 6  # the small one is enlarged
    assert filled(spark, "llava", "<image>x", images=[one]) == "<image>" * 576 + "x"  # tokens that look like the placeholder
    assert filled(spark, "pixtral", "<image>", images=[(33, 17, None, None)]) == "[IMG][IMG][IMG][IMG_BREAK][IMG][IMG][IMG][IMG_END]"
    assert filled(spark, "qwen2_vl", "<video>", videos=[(28, 28, 8, None)]).count("<|video_pad|>") == 4
    assert filled(spark, "qwen2_audio", "<audio>?", audios=[(None, None, None, 1.0)]).endswith("<|audio_eos|>?")


@pytest.mark.parametrize(("name", "content", "images"), [("qwen2_vl", "none", [(1, 1, None, None)]), ("qwen2_vl", "<image>", []), ("base", "<image>", [(1, 1, None, None)]), ("qwen2_audio", "<image>", [(9, 9, None, None)])])
def test_what_does_not_fit_is_null(spark, name, content, images):
    assert filled(spark, name, content, images=images) is None


def test_texts_without_media(spark):
    for name in plugins:
        assert filled(spark, name, "plain $1 \\E text", images=[]) == "plain $1 \\E text"


def test_tiles_follow_the_ratio(spark):
    count = lambda w, h: filled(spark, "intern_vl", "<image>", images=[(w, h, None, None)]).count("<IMG_CONTEXT>") // 256
    assert count(448, 448) == 1 and count(896, 448) == 3 and count(10, 10) == 1 and count(4480, 448) <= 13


def test_registry():
    with pytest.raises(ValueError):
        register_plugin(MediaPlugin("base", image=repeated("x", 1)))
    with pytest.raises(ValueError):
        get_plugin("nothing")


SIZES = [(336, 336), (672, 336), (100, 100), (900, 400), (400, 900), (3000, 500), (37, 1200), (1500, 1490), (1, 5000), (449, 448), (448, 448), (1344, 1344), (2000, 3000), (1008, 337)]


def plain_tiles(w, h, side=336, most=16):
    """(rows, columns): the canvas that needs least enlarging, else least shrinking, else is smallest."""
    best = None
    for i in range(1, most + 1):
        for j in range(1, most // i + 1):
            scale = min(side * i / h, side * j / w)
            own = (scale < 1, scale if scale >= 1 else -scale, i * j)
            if best is None or own < best[0]:
                best = (own, (i, j))
    return best[1]


def plain_slices(w, h, side=448, most=9):
    """(columns, rows) of slices, or none."""
    cover = min(math.ceil(w * h / side**2), most)
    if cover <= 1:
        return None
    grids = [(a, n // a) for n in (cover - 1, cover, cover + 1) if 1 < n <= most for a in range(1, n + 1) if n % a == 0]
    return min(grids, key=lambda g: round(abs(math.log(w / h) - math.log(g[0] / g[1])), 12))


def plain_unpadded(w, h, side=336, cells=24):
    best = None
    for a, b in [(1, 2), (2, 1), (2, 2), (3, 1), (1, 3)]:
        scale = min(side * b / w, side * a / h)
        kept = min(int(w * scale) * int(h * scale), w * h)
        if best is None or (-kept, side * side * a * b - kept) < best[0]:
            best = ((-kept, side * side * a * b - kept), (a, b))
    rows, columns = best[1][0] * cells, best[1][1] * cells
    if w / h > columns / rows:
        rows -= (rows - int(round(h * (columns / w), 7))) // 2 * 2
    else:
        columns -= (columns - int(round(w * (rows / h), 7))) // 2 * 2
    return rows * columns + rows + cells * cells


def test_tile_grids_against_plain_code(spark):
    images = [(w, h, None, None) for w, h in SIZES]
    marks = "<image>|" * len(SIZES)
    parts = {n: filled(spark, n, marks, images=images).split("|" if n in ("minicpm_v", "llava_next") else "<|image_end|>|") for n in ("llama4", "minicpm_v", "llava_next")}
    for k, (w, h) in enumerate(SIZES):
        i, j = plain_tiles(w, h)
        tile = "<|patch|>" * 144
        rows = "".join("<|tile_x_separator|>".join([tile] * j) + "<|tile_y_separator|>" for _ in range(i)) if i * j > 1 else ""
        assert parts["llama4"][k] == f"<|image_start|>{rows}<|image|>{tile}", (w, h)
        one = lambda name: f"<{name}>" + "<unk>" * 64 + f"</{name}>"
        grid = plain_slices(w, h)
        cut = "\n".join(one("slice") * grid[0] for _ in range(grid[1])) if grid else ""
        assert parts["minicpm_v"][k] == f"<image_id>{k}</image_id>" + one("image") + cut, (w, h)
        assert parts["llava_next"][k] == "<image>" * plain_unpadded(w, h), (w, h)


def test_frames_and_padded_grids(spark):
    got = filled(spark, "intern_vl", "<video>.", videos=[(448, 448, 2, None)])
    frame = "<img>" + "<IMG_CONTEXT>" * 256 + "</img>"
    assert got == f"Frame1: {frame}\nFrame2: {frame}."
    count = lambda w, h: filled(spark, "kimi_vl", "<image>", images=[(w, h, None, None)]).count("<|media_pad|>")
    assert count(28, 28) == 1 and count(29, 28) == 2 and count(560, 280) == 200 and count(2800, 2800) <= 1100
