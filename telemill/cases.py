"""The quality cases that answers are scored on.

Fixed values: the prompts, expected answers and scorers are those that earlier
reports were made with, so that accuracies can be compared. expected is text, or JSON
text for the scorer `json`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

CASES = (
    ("arithmetic-multiplication", "arithmetic", "Compute 739 multiplied by 864. Reply with the number only.", "638496", "number"),
    ("arithmetic-percentage", "arithmetic", "What is 17 percent of 350? Reply with the number only.", "59.5", "number"),
    ("arithmetic-order-of-operations", "arithmetic", "Compute (18 + 6) / 3. Reply with the number only.", "8", "number"),
    ("arithmetic-word-problem", "arithmetic", "A box has 6 rows of 8 bolts. Thirteen bolts are removed. How many remain? Reply with the number only.", "35", "number"),
    ("reasoning-sequence", "reasoning", "Continue the sequence 2, 6, 12, 20, 30. Reply with the next number only.", "42", "number"),
    ("reasoning-snail", "reasoning", "A snail climbs 3 meters by day and slips 2 meters by night in a 10-meter well. Reply only with the escape day number.", "8", "number"),
    ("reasoning-syllogism", "reasoning", "All norps are flims. No flims are daxes. Can any norp be a dax? Reply only yes or no.", "no", "normalized"),
    ("reasoning-ordering", "reasoning", "Mira is taller than Jo. Jo is taller than Eli. Who is shortest? Reply with the name only.", "Eli", "normalized"),
    ("reasoning-converse", "reasoning", "If the server is down, the alert is red. The alert is red. Must the server be down? Reply only yes or no.", "no", "normalized"),
    ("knowledge-capital", "knowledge", "What is the capital of Australia? Reply with the city only.", "Canberra", "normalized"),
    ("knowledge-chemistry", "knowledge", "What is the chemical symbol for tungsten? Reply with the symbol only.", "W", "normalized"),
    ("knowledge-literature", "knowledge", "Who wrote Pride and Prejudice? Reply with the author name only.", "Jane Austen", "normalized"),
    ("knowledge-astronomy", "knowledge", "What is the largest planet in the Solar System? Reply with the planet only.", "Jupiter", "normalized"),
    ("instruction-json", "instruction_following", 'Reply with exactly this JSON object and nothing else: {"status":"ok","sum":42}', '{"status":"ok","sum":42}', "json"),
    ("instruction-sort", "instruction_following", "Sort pear, apple, banana alphabetically. Reply as comma-separated lowercase words with no spaces.", "apple,banana,pear", "exact"),
    ("instruction-uppercase", "instruction_following", "Write the words local model in uppercase. Reply with those two words only.", "LOCAL MODEL", "exact"),
    ("extraction-email", "extraction", "Extract the email address from: Contact Ada at ada.lovelace@example.org before Friday. Reply with the address only.", "ada.lovelace@example.org", "normalized"),
    ("extraction-id", "extraction", "Extract the ticket ID from: Region=west; Ticket=HUB-2047; Priority=low. Reply with the ID only.", "HUB-2047", "normalized"),
    ("code-python", "code_understanding", "What does this Python expression evaluate to: sum(i * i for i in range(5))? Reply with the number only.", "30", "number"),
    ("code-javascript", "code_understanding", "What does this JavaScript expression evaluate to: [1, 2, 3].map(x => x * 2).at(-1)? Reply with the number only.", "6", "number"),
)


def cases(spark: SparkSession) -> DataFrame:
    """The cases (case_id, category, prompt, expected, scorer) as a table."""
    return spark.createDataFrame(list(CASES), "case_id string, category string, prompt string, expected string, scorer string")
