"""Text functions of the layout engine as column expressions: tokens, key labels, percentages, inputs, settings, file names."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# What a key without a printable character is shown as, by key code.
KEY_LABELS = {
    36: "↩", 48: "⇥", 49: "Space", 51: "⌫", 53: "⎋", 76: "⌅", 117: "⌦", 115: "↖", 119: "↘", 116: "⇞", 121: "⇟",
    123: "←", 124: "→", 125: "↓", 126: "↑",
    96: "F5", 97: "F6", 98: "F7", 99: "F3", 100: "F8", 101: "F9", 103: "F11", 105: "F13", 106: "F16", 107: "F14", 109: "F10", 111: "F12", 113: "F15", 118: "F4", 120: "F2", 122: "F1",
}
# The characters that menus know such keys by.
MENU_KEYS = {36: "\r", 48: "\t", 49: " ", 51: "\x7f", 53: "\x1b", 76: "\x03", 117: "\uf728", 123: "\uf702", 124: "\uf703", 125: "\uf701", 126: "\uf700"}
# Modifier bits and their glyphs, in the order of a label.
MODIFIERS = ((1 << 18, "⌃"), (1 << 19, "⌥"), (1 << 17, "⇧"), (1 << 20, "⌘"))
#: Unicode white space, as a class that other engines read too.
SPACES = r"[\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def tokens(text: Column) -> Column:
    """White-space tokens; an array, empty for a text without any."""
    return F.filter(F.split(text, SPACES), lambda t: t != "")


def _looked_up(table: dict[int, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(v) for pair in table.items() for v in pair)), key.cast("int"))


def key_label(key_code: Column, character: Column) -> Column:
    """A key's glyph, else its recorded character in upper case, else its number."""
    shown = F.upper(F.regexp_replace(character, f"^{SPACES}|{SPACES}$", ""))
    return F.coalesce(_looked_up(KEY_LABELS, key_code), F.when(shown != "", shown), F.concat(F.lit("Key #"), key_code.cast("string")))


def shortcut_label(key_code: Column, mods: Column, character: Column) -> Column:
    """The glyphs of the modifiers that are set, then the key."""
    glyphs = [F.when(mods.bitwiseAND(F.lit(bit)) != 0, glyph).otherwise("") for bit, glyph in MODIFIERS]
    return F.concat(*glyphs, key_label(key_code, character))


def menu_key(key_code: Column, character: Column) -> Column:
    """What a menu item's key equivalent is: a special character, else the recorded one in lower case."""
    return F.coalesce(_looked_up(MENU_KEYS, key_code), F.lower(character))


def percent_label(value: Column) -> Column:
    """A sensitivity as a percentage of 4, without decimals."""
    return F.format_string("%.0f%%", F.round(value * 25))


def padding(text: Column, default: int = 8) -> Column:
    """A number of pixels typed in, with either decimal sign; what is no number, or negative, is the default."""
    value = F.replace(F.trim(text), F.lit(","), F.lit(".")).try_cast("double")
    return F.coalesce(F.when(value >= 0, F.round(value)).cast("int"), F.lit(default))


def read_settings(json: Column) -> Column:
    """key_code and sensitivity (not below 0; 1 if it is missing) of settings kept as JSON."""
    read = F.from_json(json, "key_code int, sensitivity double")
    return F.struct(read["key_code"].alias("key_code"), F.greatest(F.lit(0.0), F.coalesce(read["sensitivity"], F.lit(1.0))).alias("sensitivity"))


def capture_name(ts: Column) -> Column:
    """The file name of a capture at a time."""
    return F.concat(F.lit("Capture_"), F.date_format(ts, "yyyyMMdd_HHmmss"), F.lit(".png"))
