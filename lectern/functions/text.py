"""Text functions, Column to Column, all within code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What Unicode-aware white space is to the engine: Java's, and the four separators that it leaves out.
SPACE = r"(?U)[\s\x1c-\x1f]"
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"

#: Words that are no keywords, in English and French.
STOPWORDS = tuple(
    "a ainsi also an and après are as at au aux avait avant avec be but by can ce ces cet cette chez comme could d dans de des did do does dont down du "
    "entre est et for from had has have here if in into is it la le les leur leurs mais may might ne not of on ont or ou our out où par pas plus pour quand "
    "que qui quoi sa sans se ses shall should so son sont sous sur than that the their them then there these they this those to un une up us vers was we "
    "were will with would you your yours étaient était été être".split()
)


def token_count(text: Column) -> Column:
    """Words between white space; 0 for a text of none, null for null."""
    return F.size(F.filter(F.split(text, f"{SPACE}+"), lambda x: x != "")).cast("int")


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def normalized_space(text: Column) -> Column:
    """Stripped, with every run of white space as one space."""
    return strip(F.regexp_replace(text, f"{SPACE}+", " "))


def split_lines(text: Column) -> Column:
    """Lines at any Unicode line end; no empty line after the last end, none for an empty text."""
    lines = F.split(text, LINE_END)
    return F.when(F.element_at(lines, -1) == "", F.slice(lines, 1, F.greatest(F.size(lines) - 1, F.lit(0)))).otherwise(lines)


def file_stem(name: Column) -> Column:
    """The name without its last suffix."""
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def cleaned_keyword(text: Column) -> Column:
    """Without label, list mark, and the quotes, brackets and punctuation around it; single spaces."""
    out = F.regexp_replace(strip(text), r"(?iu)^(?:keywords?|mots?-?\s*clés?)(?U)\s*:\s*", "")
    out = F.regexp_replace(out, r"^(?U)\s*(?:\d+[.)]|[-–•●·])\s*", "")
    return F.regexp_replace(F.btrim(strip(out), F.lit(" \t\r\n\"'.,;:()[]{}")), f"{SPACE}+", " ")


def deepest(headings: list[Column]) -> Column:
    """The last heading that isn't blank, stripped; null without one."""
    return F.coalesce(*(F.nullif(strip(h), F.lit("")) for h in reversed(headings)))


def parsed_list(reply: Column) -> Column:
    """A JSON list of strings within a reply, from its first '[' to its last ']'; null if there is none."""
    return F.from_json(F.regexp_extract(reply, r"(?s)\[.*\]", 0), "array<string>")


#: An embedded image; its second group is the data URL, its third the base64 data.
IMAGE = r"!\[([^\]]*)\]\((data:image/[a-zA-Z0-9.+-]+;base64,([^)]+))\)"


def image_text_only(text: Column, description: str = "pas de description") -> Column:
    """Embedded images replaced by a constant description between the image tags."""
    return F.regexp_replace(text, IMAGE, f"<IMAGE DESCRIPTION START>{description}<IMAGE DESCRIPTION END>")


def one_line(text: Column) -> Column:
    """A text as an embedding service takes it: line ends as spaces, stripped, a space for nothing."""
    out = strip(F.translate(text, "\r\n", "  "))
    return F.when(out == "", F.lit(" ")).otherwise(out)


def shell_quoted(text: Column) -> Column:
    """A text within single quotes, as one word of a shell."""
    return F.concat(F.lit("'"), F.replace(text, F.lit("'"), F.lit("'\"'\"'")), F.lit("'"))


def utc_now() -> Column:
    """The time of the query in UTC, in whole seconds, as 2000-01-02T03:04:05Z."""
    return F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def plain_digits(text: Column) -> Column:
    return text.rlike("^[0-9]+$")


def parameter(encoded: Column) -> Column:
    """A parameter that came base64-encoded; null for what isn't."""
    return F.try_to_binary(encoded, F.lit("base64")).cast("string")
