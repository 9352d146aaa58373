"""Fixed values of the file formats, the kinds and the script versions."""

from __future__ import annotations

# Signatures and text markers, as the formats have them.
ARCHIVE_MAGIC = b"BURIKO ARC20"
IMAGE_MAGIC = b"CompressedBG___\0"
PACKED_SCRIPT_MAGIC = b"DSC FORMAT 1.00\0"
SCRIPT_MAGIC = b"BurikoCompiledScriptVer1.00\0"
AUDIO_MAGIC = b"bw  "
CODE_END = b"\x1b\0\0\0"
PROJECT_MAGIC = "# BGI_HAZUKI_DSC_TEXT_V1"
PROJECT_SUFFIX = ".hazuki.txt"
PATCHED_SUFFIX = ".patched"

ARCHIVE_HEAD, ARCHIVE_ENTRY, ARCHIVE_NAME = 16, 128, 96

# Label and suggested extension of each kind, in the order of the tests.
KINDS = {
    "image": ("cbg-image", ".png"),
    "dsc": ("dsc-script", ".hazuki.txt"),
    "compiled": ("compiled-script", ".hazuki.txt"),
    "audio": ("bgi-audio", ".ogg"),
    "png": ("png-image", ".png"),
    "jpeg": ("jpeg-image", ".jpg"),
    "bmp": ("bmp-image", ".bmp"),
    "ogg": ("ogg-audio", ".ogg"),
    "wav": ("wav-audio", ".wav"),
    "unknown": ("unknown", ""),
}

# The rank of a reference's kind.
RANK = {"name": 7, "text": 6, "ruby_kanji": 5, "ruby_furigana": 4, "backlog": 3, "file": 2, "other": 1}
COMMENT = {"name": "NAME", "text": "TEXT", "ruby_kanji": "TEXT RUBY KANJI", "ruby_furigana": "TEXT RUBY FURIGANA", "backlog": "TEXT BACKLOG", "file": "FILE", "other": "OTHER"}

# Opcodes and functions of both script versions.
STRING_OPCODE, FILE_OPCODE = 0x3, 0x7F
TEXT_FUNCTION, BACKLOG_FUNCTION, RUBY_FUNCTION = 0x140, 0x143, 0x14B

# Byte distance from a reference to the function that tells its kind.
DISTANCE = {
    "0.00": {"name": 0x24, "text": 0x2C, "ruby_kanji": 0x14, "ruby_furigana": 0x0C, "backlog": 0x0C},
    "1.00": {"name": 0x0C, "text": 0x04, "ruby_kanji": 0x04, "ruby_furigana": 0x0C, "backlog": 0x0C},
}
FUNCTION = {"name": TEXT_FUNCTION, "text": TEXT_FUNCTION, "ruby_kanji": RUBY_FUNCTION, "ruby_furigana": RUBY_FUNCTION, "backlog": BACKLOG_FUNCTION}
