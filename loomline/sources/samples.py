"""Small embedded corpora of our own: labelled sentences, and engineered narratives with the predicates they should meet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SENTENCES = [
    ("g01", "I love our home and I am so happy.", "pos", "joy", "secure"), ("g02", "I hate this and I am angry.", "neg", "anger", "none"), ("g03", "The bus leaves at nine.", "neu", "none", "none"),
    ("g04", "I am afraid you will leave me.", "neg", "fear", "anxious"), ("g05", "We talk it out and I trust you.", "pos", "trust", "secure"), ("g06", "I feel lonely and broken.", "neg", "sadness", "none"),
    ("g07", "I need space and distance.", "neu", "none", "avoidant"), ("g08", "I am grateful and very proud.", "pos", "joy", "none"), ("g09", "You betrayed me and I am hurt.", "neg", "sadness", "anxious"),
    ("g10", "He opened the window.", "neu", "none", "none"), ("g11", "It was a wonderful, kind evening.", "pos", "joy", "none"), ("g12", "I am not happy.", "neg", "sadness", "none"),
]

#: Narrative, then the predicates over the metric row that hold for it.
NARRATIVES = {
    "positive": ("I love my life. I am happy and grateful. We trust each other. I feel safe and proud. It is wonderful.", ["sentiment > 0", "gase > 0", "abs(nava) < 0.5", "cd_index < 0.3"]),
    "negative": ("I hate this. I am angry and hurt. He betrayed me. I am lonely and broken. It is terrible and I am afraid.", ["sentiment < 0", "vads > 0.2"]),
    "falling": ("I was happy. It was wonderful. I felt safe and proud.\n\nThen he betrayed me. I am hurt. I am lonely and broken.", ["nava > 0", "lewi_drop > 0", "teg > 0.05"]),
    "self": ("I think I am lost. I know I want my own way. I told myself my story. I am me.", ["pti > 0.3"]),
    "distorted": ("Everything is ruined. I always fail, never win. It is a disaster. They must think I am a failure. It will never work. I should have known. It is obvious.", ["cd_index > 0.2"]),
    "contradictory": ("He always calls. He never calls. Everyone came and nobody stayed.", ["ties > 0"]),
    "neutral": ("The train stops here. The table is brown. Rain is due at noon. Paper lies on a desk.", ["abs(sentiment) < 0.3", "cd_index < 0.2", "gase between 0.65 and 0.75"]),
}


def gold_sentences(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SENTENCES, "id string, text string, sentiment string, emotion string, attachment string")


def engineered(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, t) for k, (t, _) in NARRATIVES.items()], "doc_id string, text string")
