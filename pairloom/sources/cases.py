"""Built-in tables: labelled correction cases, training curves, sample sentences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Labelled cases (corrupted, clean), by set and group.
CASES = {
    "accuracy_26": {
        "basic": [
            ("I beleive this is teh correct answr.", "I believe this is the correct answer."),
            ("She recieved her degre last year.", "She received her degree last year."),
            ("The resturant serves excelent food.", "The restaurant serves excellent food."),
            ("He is studyng for his final examintion.", "He is studying for his final examination."),
            ("We dicussed the importnt details yesterday.", "We discussed the important details yesterday."),
        ],
        "complex": [
            ("The begining of the story was very excting.", "The beginning of the story was very exciting."),
            ("I definately need to imporve my skils.", "I definitely need to improve my skills."),
            ("The experiance was chalenging and rewardng.", "The experience was challenging and rewarding."),
            ("Please chekc your emial for more informaton.", "Please check your email for more information."),
            ("This documetn contians several importatn points.", "This document contains several important points."),
        ],
        "keyboard": [
            ("The qucik brown fox jumoed over the fence.", "The quick brown fox jumped over the fence."),
            ("Teh meetign has been rescheduled for tommorow.", "The meeting has been rescheduled for tomorrow."),
            ("Thank you for your consideratin of my applicaton.", "Thank you for your consideration of my application."),
        ],
        "multiple": [
            ("I am goign to teh store to buy som grocerys.", "I am going to the store to buy some groceries."),
            ("The waether forcast predicts rain tommorow mornign.", "The weather forecast predicts rain tomorrow morning."),
        ],
        "confusions": [
            ("I want to loose some weight this year.", "I want to lose some weight this year."),
            ("There going to there house tomorrow.", "They're going to their house tomorrow."),
            ("Its a beautiful day, isnt it?", "It's a beautiful day, isn't it?"),
        ],
        "professional": [
            ("The research metodology was carefuly designed.", "The research methodology was carefully designed."),
            ("Students must submitt their assigments on time.", "Students must submit their assignments on time."),
        ],
        "edge": [("Teh.", "The."), ("This sentence has no errors.", "This sentence has no errors.")],
        "real-world": [
            ("Please find the attachd document for your reveiw.", "Please find the attached document for your review."),
            ("The technolgy has advaced significantely.", "The technology has advanced significantly."),
            ("Communication skils are esential for sucess.", "Communication skills are essential for success."),
            ("Enviromental protecton requires imediate atention.", "Environmental protection requires immediate attention."),
        ],
    },
    "short_12": {
        "all": [
            ("I beleive this is teh correct answr.", "I believe this is the correct answer."),
            ("This is a sentnce with mny typos.", "This is a sentence with many typos."),
            ("The qick brown fox jumps ovr the lazy dog.", "The quick brown fox jumps over the lazy dog."),
            ("Please chck your email for futher instructions.", "Please check your email for further instructions."),
            ("I recieved your mesage yesterday.", "I received your message yesterday."),
            ("We need to discus this matter urgently.", "We need to discuss this matter urgently."),
            ("The meetng is schedled for tomorrow.", "The meeting is scheduled for tomorrow."),
            ("Can you plese send me the documnt?", "Can you please send me the document?"),
            ("This is alredy completd.", "This is already completed."),
            ("I dont understnd what you mean.", "I don't understand what you mean."),
            ("Ther are sevral erors in you're text.", "There are several errors in your text."),
            ("Its importnt to check you're work carefuly.", "It's important to check your work carefully."),
        ],
    },
    "difficulty_8": {
        "easy": [("I beleive this is correct.", "I believe this is correct."), ("The qucik brown fox.", "The quick brown fox.")],
        "medium": [("I beleive this is teh correct answr.", "I believe this is the correct answer."), ("She recieved her degre last year.", "She received her degree last year.")],
        "hard": [
            ("The goverment anounced new polices yesterday.", "The government announced new policies yesterday."),
            ("Unfortunatly, the experiance was dissapointing.", "Unfortunately, the experience was disappointing."),
            ("Their going to there house over they're.", "They're going to their house over there."),
            ("The studnets where asked to wright an esay.", "The students were asked to write an essay."),
        ],
    },
}
# A training run: (step, loss), and its held-out losses.
TRAIN_CURVE = [(50, 1.58), (100, 0.79), (150, 0.61), (200, 0.56), (250, 0.50), (300, 0.47), (350, 0.45), (400, 0.42), (450, 0.40), (500, 0.40)]
HELD_CURVE = [(250, 0.408), (500, 0.353), (750, 0.347)]
#: Sentences for when no source can be read; written for this package.
SAMPLES = [
    "The train to the coast leaves early in the morning.", "We should meet before the end of the week.", "Please check the report before you send it.", "She found an old map in the attic of the house.",
    "First open the lid, then pour in the water slowly.", "The study shows how plants grow in poor soil.", "I really think this soup needs more salt.", "They walked along the river until it was dark.",
]

#: Sentences for each domain, for when there are too few to balance: beginnings and ends, each with each; written for this package.
DOMAIN_PARTS = {
    "conversational": (["I really think that", "You know,", "Maybe", "To be honest,"], ["we should call them tonight.", "it was a good idea to wait.", "the soup needs more salt.", "nobody minds the rain today.", "we can walk home from here."]),
    "professional": (["The team agreed that", "Please note that", "Our client confirmed that", "The report shows that"], ["the meeting moves to Monday.", "the budget covers both offices.", "the contract ends in spring.", "the new process saves time.", "every order left on schedule."]),
    "educational": (["The study shows that", "Students learn that", "According to the text,", "Research explains why"], ["plants turn light into food.", "rivers carve deep valleys.", "metals expand when they are heated.", "sleep helps us to remember.", "old maps differ from new ones."]),
    "creative": (["Under the old bridge", "Beyond the silent garden", "In the pale light of dawn", "At the edge of the forest"], ["a lantern swung in the wind.", "the fox waited for the moon.", "a forgotten song began again.", "the river kept its secret.", "two shadows crossed the snow."]),
    "instructional": (["First,", "Then,", "Before you go on,", "Finally,"], ["close the lid and press the button.", "check that the cable is tight.", "pour the water in slowly.", "write down the number on the label.", "turn the handle to the left."]),
    "general": (["The museum says that", "In most towns", "Every year", "On quiet days"], ["the market opens at eight.", "buses run along the coast.", "people plant trees in autumn.", "the library lends tools too.", "the harbour fills with boats."]),
}


def domain_samples(spark: SparkSession, each: int = 20, times: int = 1) -> DataFrame:
    """domain, pos, sentence: up to 20 built-in sentences of each of the six domains, the whole as often as asked."""
    made = [(d, i, f"{a} {b}") for d, (starts, ends) in DOMAIN_PARTS.items() for i, (a, b) in enumerate([(a, b) for b in ends for a in starts][:each])]
    rows = spark.createDataFrame(made, "domain string, pos int, sentence string")
    again = rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(times - 1))).alias("time"))
    return again.select("domain", (F.col("pos") + F.col("time") * each).alias("pos"), "sentence")


def rows() -> list[tuple[str, int, str, str, str]]:
    """(set, case_id, group, corrupted, clean)."""
    out = []
    for name, groups in CASES.items():
        n = 0
        for group, pairs in groups.items():
            for bad, good in pairs:
                out.append((name, n, group, bad, good))
                n += 1
    return out


def cases(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(rows(), "case_set string, case_id int, case_group string, corrupted string, clean string")


def curve(spark: SparkSession, points: list[tuple[int, float]]) -> DataFrame:
    return spark.createDataFrame(points, "step int, loss double")


def samples(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(SAMPLES)), "doc_id long, text string")
