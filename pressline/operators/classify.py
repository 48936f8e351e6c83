"""External classification: the table of requests, and the decoded answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pressline.functions.once import computed_once, let
from pressline.functions.text import truthy
from pressline.sources.schemas import ANSWER

REQUEST_CHARS = 2000
TEMPERATURE = 0.1
DEFAULT_TYPE = "Sonstige"

# Short names of incident types.
TYPE_ALIASES = {"A": "Automatenspiel", "W": "Wetten", "O": "Online-Spiele"}

# Own wording; the field names and type names are fixed values.
INSTRUCTION = (
    "Lies die folgende Polizeimeldung und antworte nur mit einem JSON-Objekt. Felder: "
    "'ort' (Name des Tatorts ohne Präposition), "
    "'typ' ('Automatenspiel', 'Wetten', 'Online-Spiele' oder 'Sonstige'), "
    "'koord' (Objekt mit 'lat' und 'lon' des Tatorts in Deutschland, sonst null), "
    "'bundesland' (Name des Bundeslands, sonst null), "
    "'illegal' (true nur bei eindeutig illegalem Glücksspiel, sonst false).\n\nMeldung:\n"
)


def request_text(text: Column, instruction: str | None = INSTRUCTION, pre_cut: int | None = None) -> Column:
    """Instruction and the start of the article; without instruction the bare start."""
    start = F.substring(F.substring(text, 1, pre_cut) if pre_cut else text, 1, REQUEST_CHARS)
    return F.concat(F.lit(instruction), start) if instruction else start


def classification_requests(
    articles: DataFrame, model: str, instruction: str | None = INSTRUCTION, text: str = "content_text"
) -> DataFrame:
    """One request per article: ``url`` and the JSON ``request``."""
    return articles.select("url", request(F.col(text), model, instruction).alias("request"))


def request(text: Column, model: str, instruction: str | None = INSTRUCTION) -> Column:
    """The JSON request for one text."""
    message = F.struct(F.lit("user").alias("role"), request_text(text, instruction).alias("content"))
    return F.to_json(F.struct(
        F.lit(model).alias("model"), F.array(message).alias("messages"), F.lit(TEMPERATURE).alias("temperature")
    ))


def decode_answer(response: Column) -> Column:
    """Answer struct inside a model response; null where any layer is not what it should be."""
    content = F.get_json_object(response, "$.choices[0].message.content")
    return F.from_json(let(content, truthy), ANSWER)


def decode_answers(responses: DataFrame, response: str = "response") -> DataFrame:
    return computed_once(responses, {"answer": decode_answer(F.col(response))}).drop(response)


def coordinate_text(number: Column) -> Column:
    """Coordinate of an answer as text; every notation of zero becomes ``0``, which counts as missing."""
    return F.when(number.try_cast("double") == 0, F.lit("0")).otherwise(number)


def is_illegal(answer: Column) -> Column:
    """Only the JSON value ``true``; text, numbers and missing fields are false."""
    return F.coalesce(answer["illegal"], F.lit(False))


def illegal_only(df: DataFrame, answer: str = "answer") -> DataFrame:
    return df.filter(is_illegal(F.col(answer)))


def one_answer_per_url(answers: DataFrame) -> DataFrame:
    """The smallest response text where a URL was answered more than once."""
    return answers.groupBy("url").agg(F.min("response").alias("response"))


def with_answers(articles: DataFrame, answers: DataFrame) -> DataFrame:
    """Articles with their decoded answer, null where the model gave none."""
    decoded = decode_answers(one_answer_per_url(answers))
    return articles.join(decoded, "url", "left")


def incident_type(c: Column) -> Column:
    """Default for a missing type; an empty one stays."""
    return F.coalesce(c, F.lit(DEFAULT_TYPE))


def canonical_type(c: Column) -> Column:
    """Short type names written out; missing and empty types are the default."""
    aliases = F.create_map(*[F.lit(x) for pair in TYPE_ALIASES.items() for x in pair])
    return F.coalesce(F.try_element_at(aliases, c), F.when(c != "", c), F.lit(DEFAULT_TYPE))
