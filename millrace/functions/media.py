"""Media in messages: placeholders become the tokens that a model wants for each image, video or audio, as Column expressions.

A plugin is data: the tokens around and inside, and a rule for how many tokens a medium of given size takes. Register others with
register_plugin(). A message with more or fewer placeholders than media gives null.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import media_counts_match

#: The placeholders in messages.
IMAGE, VIDEO, AUDIO = "<image>", "<video>", "<audio>"

#: From a medium (struct width, height, frames, seconds) to its tokens.
Tokens = Callable[[Column], Column]


def _int(x: Column) -> Column:
    return x.cast("int")


def repeated(token: str, n: int | Callable[[Column], Column], before: str = "", after: str = "") -> Tokens:
    """token n times, between before and after."""
    return lambda m: F.concat(F.lit(before), F.repeat(F.lit(token), F.lit(n) if isinstance(n, int) else _int(n(m))), F.lit(after))


def snapped(m: Column, unit: int, least: int, most: int) -> tuple[Column, Column]:
    """Height and width as multiples of unit whose product is between least and most pixels, in about the same ratio."""
    h, w = m["height"].cast("double"), m["width"].cast("double")
    by = lambda f, x: F.greatest(F.lit(unit), f(x / unit) * unit)
    near = (by(F.round, h), by(F.round, w))
    down, up = F.sqrt(h * w / most), F.sqrt(F.lit(float(least)) / (h * w))
    area = near[0] * near[1]
    return tuple(F.when(area > most, by(F.floor, x / down)).when(area < least, by(F.ceil, x * up)).otherwise(n) for x, n in zip((h, w), near, strict=True))


def grid(patch: int, merge: int, least: int, most: int, frames_a_step: int = 2) -> Callable[[Column], Column]:
    """Patches of the snapped size, merged merge by merge; of a video times its steps."""

    def count(m: Column) -> Column:
        h, w = snapped(m, patch * merge, least, most)
        steps = F.greatest(F.ceil(F.coalesce(m["frames"], F.lit(1)) / frames_a_step), F.lit(1))
        return steps * (h / (patch * merge)) * (w / (patch * merge))

    return count


def rows(token: str, line: str, end: str, patch: int) -> Tokens:
    """A line of tokens for each row of patches, parted by line and closed by end."""

    def made(m: Column) -> Column:
        h, w = (F.greatest(F.ceil(m[k] / patch), F.lit(1)).cast("int") for k in ("height", "width"))
        return F.concat(F.array_join(F.array_repeat(F.repeat(F.lit(token), w), h), line), F.lit(end))

    return made


def tiles(token: str, side: int, each: int, most: int, before: str, after: str) -> Tokens:
    """each tokens for every tile of the grid nearest to the ratio of the sides, of at most so many tiles, and for a thumbnail if
    there is more than one."""
    shapes = sorted(((i, j) for i in range(1, most + 1) for j in range(1, most + 1) if i * j <= most), key=lambda s: s[0] * s[1])

    def made(m: Column) -> Column:
        ratio, area = m["width"] / m["height"], m["width"] * m["height"]
        # of equal ratios the larger grid, if the picture fills half of it
        ranked = [F.struct(F.abs(ratio - i / j).alias("d"), F.when(area > 0.5 * side * side * i * j, F.lit(-i * j)).otherwise(F.lit(i * j)).alias("n"), F.lit(i * j).alias("tiles")) for i, j in shapes]
        n = F.array_min(F.array(*ranked))["tiles"]
        return F.concat(F.lit(before), F.repeat(F.lit(token), _int((n + F.when(n > 1, 1).otherwise(0)) * each)), F.lit(after))

    return made


def bound(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value worked out once, however often then names it."""
    return F.transform(F.array(value), then)[0]


def best_shape(shapes: list[tuple[int, int]], rank: Callable[[Column, Column], list[Column]]) -> Column:
    """The shape (struct a, b) whose ranks are least, compared one after the other; of equal ones the first."""
    known = F.from_json(F.lit(json.dumps([{"i": i, "a": a, "b": b} for i, (a, b) in enumerate(shapes)])), "array<struct<i: int, a: int, b: int>>")  # a constant, folded once
    ranked = F.transform(known, lambda s: F.struct(*[r.cast("double").alias(f"r{k}") for k, r in enumerate(rank(s["a"], s["b"]))], s["i"].alias("i"), s["a"].alias("a"), s["b"].alias("b")))
    return F.array_min(ranked)


def fitting_tiles(token: str, side: int, each: int, most: int, marks: tuple[str, str, str, str, str]) -> Tokens:
    """each tokens for every tile of the grid of at most so many tiles that the picture fits best, then those of the whole picture.

    A grid that holds the picture comes before one that shrinks it; of those that hold it the one that enlarges it least, of the others the one that
    shrinks it least, and of equal ones the smallest. marks: before all, between tiles of a row, after a row, before the whole picture, after all.
    """
    start, across, down, whole, end = marks
    shapes = sorted(((i, j) for i in range(1, most + 1) for j in range(1, most + 1) if i * j <= most), key=lambda s: (s[0] * s[1], s))

    def made(m: Column) -> Column:
        def rank(i: Column, j: Column) -> list[Column]:
            scale = F.least(side * i / m["height"], side * j / m["width"])
            return [F.when(scale >= 1, 0).otherwise(1), F.when(scale >= 1, scale).otherwise(-scale)]

        tile = F.lit(token * each)

        def tiled(best: Column) -> Column:
            row = F.concat(F.array_join(F.array_repeat(tile, best["b"]), across), F.lit(down))
            return F.when(best["a"] * best["b"] > 1, F.repeat(row, best["a"])).otherwise(F.lit(""))

        return F.concat(F.lit(start), bound(best_shape(shapes, rank), tiled), F.lit(whole), tile, F.lit(end))

    return made


def slices(token: str, side: int, each: int, most: int, numbered: bool = True) -> Tokens:
    """each tokens for the whole picture, then for each slice of the grid nearest to its ratio, a line for each row of slices.

    The grid has about as many slices as squares of that side cover the picture, one more or less, at most so many; a picture of one
    square has none. numbered: the picture's number in its message stands before it.
    """
    shapes = [(a, n // a) for n in range(2, most + 1) for a in range(1, n + 1) if n % a == 0]

    def made(m: Column) -> Column:
        ratio, cover = F.log(m["width"] / m["height"]), F.least(F.ceil(m["width"] * m["height"] / (side * side)), F.lit(most))
        def rank(a: Column, b: Column) -> list[Column]:
            return [F.when(F.abs(cover - a * b) <= 1, 0).otherwise(1), F.round(F.abs(ratio - F.log(a / b)), 12)]

        one = lambda name: F.lit(f"<{name}>{token * each}</{name}>")
        number = F.concat(F.lit("<image_id>"), m["index"].cast("string"), F.lit("</image_id>")) if numbered else F.lit("")
        grid = bound(best_shape(shapes, rank), lambda best: F.array_join(F.array_repeat(F.repeat(one("slice"), best["a"]), best["b"]), "\n"))
        return F.concat(number, one("image"), F.when(cover > 1, grid).otherwise(F.lit("")))

    return made


def unpadded(token: str, side: int, patch: int, shapes: list[tuple[int, int]]) -> Tokens:
    """The tokens of the whole picture at that side, then those of the best canvas without its padding, and one for each of its rows.

    shapes: heights and widths of canvases, in sides. The best has most pixels of the picture, then the least waste.
    """
    cells = side // patch

    def made(m: Column) -> Column:
        h, w = m["height"].cast("double"), m["width"].cast("double")

        def rank(a: Column, b: Column) -> list[Column]:
            scale = F.least(side * b / w, side * a / h)
            kept = F.least(F.floor(w * scale) * F.floor(h * scale), h * w)
            return [-kept, side * side * a * b - kept]

        cut = lambda size, room: room - F.floor((room - F.floor(F.round(size, 7))) / 2) * 2

        def count(best: Column) -> Column:
            rows, columns = best["a"] * cells, best["b"] * cells
            wide = w / h > columns / rows
            own_rows = F.when(wide, cut(h * (columns / w), rows)).otherwise(rows)
            return own_rows * F.when(wide, columns).otherwise(cut(w * (rows / h), columns)) + own_rows + cells * cells

        return F.repeat(F.lit(token), _int(bound(best_shape(shapes, rank), count)))

    return made


def padded_grid(side: int, patch: int, merge: int, most: int) -> Callable[[Column], Column]:
    """Merged patches of the picture, shrunk to at most so many patches and padded to whole merged ones; side bounds patches a side."""

    def count(m: Column) -> Column:
        h, w = m["height"], m["width"]
        patches = F.floor(w / patch) * F.floor(h / patch)
        scale = F.when(patches > most, F.sqrt(most / patches)).otherwise(1.0)
        sides = [F.least(F.ceil(F.floor(x * scale) / (patch * merge)), F.lit(side // merge)) for x in (h, w)]
        return sides[0] * sides[1]

    return count


def framed(token: str, each: int, before: str, after: str) -> Tokens:
    """each tokens for every frame, numbered, a line each."""
    one = f"{before}{token * each}{after}"
    return lambda m: F.array_join(F.transform(F.sequence(F.lit(1), _int(m["frames"])), lambda i: F.concat(F.lit("Frame"), i.cast("string"), F.lit(": " + one))), "\n")


def _filled(parts: Column, media: Column, tokens: Tokens) -> Column:
    """The parts of a text with the tokens of each medium between them; a medium's field index is its number in the text."""
    media = F.transform(media, lambda m, i: m.withField("index", i))
    after = F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))
    return F.concat(F.get(parts, F.lit(0)), F.array_join(F.zip_with(media, after, lambda m, rest: F.concat(tokens(m), F.coalesce(rest, F.lit("")))), ""))


@dataclass(frozen=True)
class MediaPlugin:
    name: str
    image: Tokens | None = None
    video: Tokens | None = None
    audio: Tokens | None = None

    def expanded(self, content: Column | str, images: Column | None = None, videos: Column | None = None, audios: Column | None = None) -> Column:
        """content with each placeholder replaced by its medium's tokens, in order; null where counts differ. A kind that the plugin
        doesn't take must not occur."""
        out = F.col(content) if isinstance(content, str) else content
        ok = F.lit(True)
        for mark, media, tokens in ((IMAGE, images, self.image), (VIDEO, videos, self.video), (AUDIO, audios, self.audio)):
            given = F.array().cast("array<int>") if media is None else media
            ok = ok & media_counts_match(out, mark, given)
            if media is None or tokens is None:
                ok = ok & (F.size(given) == 0)
                continue
            out = F.when(F.size(media) > 0, _filled(F.split(out, rf"\Q{mark}\E", -1), media, tokens)).otherwise(out)
        return F.when(ok, out)


plugins: dict[str, MediaPlugin] = {}


def register_plugin(plugin: MediaPlugin) -> MediaPlugin:
    if plugin.name in plugins:
        raise ValueError(f"plugin {plugin.name} is registered already")
    plugins[plugin.name] = plugin
    return plugin


def get_plugin(name: str) -> MediaPlugin:
    if name not in plugins:
        raise ValueError(f"plugin {name} does not exist")
    return plugins[name]


# The tokens and sizes that models of these families were trained on.
_QWEN = grid(14, 2, 56 * 56, 768 * 768)
register_plugin(MediaPlugin("base"))
register_plugin(MediaPlugin("llava", image=repeated("<image>", 576)))
register_plugin(MediaPlugin("llava_next", image=unpadded("<image>", 336, 14, [(1, 2), (2, 1), (2, 2), (3, 1), (1, 3)])))
register_plugin(MediaPlugin("paligemma", image=repeated("<image>", 256)))
register_plugin(MediaPlugin("gemma3", image=repeated("<image_soft_token>", 256, "\n\n<start_of_image>", "<end_of_image>\n\n")))
register_plugin(MediaPlugin("mllama", image=repeated("<|image|>", 1)))
register_plugin(MediaPlugin("intern_vl", image=tiles("<IMG_CONTEXT>", 448, 256, 12, "<img>", "</img>"), video=framed("<IMG_CONTEXT>", 256, "<img>", "</img>")))
register_plugin(MediaPlugin("pixtral", image=rows("[IMG]", "[IMG_BREAK]", "[IMG_END]", 16)))
register_plugin(MediaPlugin("qwen2_vl", image=repeated("<|image_pad|>", _QWEN, "<|vision_start|>", "<|vision_end|>"), video=repeated("<|video_pad|>", grid(14, 2, 16 * 16, 256 * 256), "<|vision_start|>", "<|vision_end|>")))
register_plugin(MediaPlugin("qwen2_audio", audio=repeated("<|AUDIO|>", lambda m: F.floor((F.floor((F.floor(m["seconds"] * 100) - 1) / 2) + 1 - 2) / 2) + 1, "<|audio_bos|>", "<|audio_eos|>")))
register_plugin(MediaPlugin("llama4", image=fitting_tiles("<|patch|>", 336, 144, 16, ("<|image_start|>", "<|tile_x_separator|>", "<|tile_y_separator|>", "<|image|>", "<|image_end|>"))))
register_plugin(MediaPlugin("minicpm_v", image=slices("<unk>", 448, 64, 9)))
register_plugin(MediaPlugin("kimi_vl", image=repeated("<|media_pad|>", padded_grid(512, 14, 2, 4096), "<|media_start|>image<|media_content|>", "<|media_end|>")))
