"""Names of year folders, in the languages that the exports use."""

import re

# Prefixes of the year folders, each followed by four digits.
YEAR_PREFIXES = (
    "Photos from ",
    "Photos of ",
    "Fotos von ",
    "Photos de ",
    "Foto del ",
    "Fotos de ",
    "Foto's van ",
    "Zdjęcia z ",
    "Фотографии из ",
    "Foton från ",
    "Bilder fra ",
    "Billeder fra ",
    "Fotoğraflar ",
    "Fotografie z ",
    "Fotók a ",
    "Φωτογραφίες από ",
    "Fotografii din ",
    "Foto dari ",
    "รูปภาพจาก ",
    "Ảnh từ ",
)

#: Java and Python regular expression of a whole year folder; group 1 is the year.
YEAR_FOLDER = "^(?:" + "|".join(re.sub(r"([.'?+*()])", r"\\\1", p) for p in YEAR_PREFIXES) + r")(\d{4})$"
