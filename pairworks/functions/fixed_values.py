"""Texts, limits and classes that results depend on."""

# Whitespace removed by Python's str.strip().
PYTHON_WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# Whitespace matched by \s and removed by trim() in JavaScript.
JS_WHITESPACE = (
    "\t\n\x0b\x0c\r \xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000\ufeff"
)

# Training and evaluation prompt.
PROMPT_TEMPLATE = "Input: {input}\nOutput:"
STOP_SEQUENCES = ("Input:", "\n")
MAX_NEW_TOKENS = 64
IGNORED_LABEL = -100
DEFAULT_MAX_LEN = 512
SPLIT_SEED = 42

# File gate.
PAIR_FILE_SUFFIX = ".jsonl"
MAX_FILE_BYTES = 100 * 1024 * 1024
UNSAFE_NAME_CHARS = "[^a-zA-Z0-9_.-]"
ARTIFACT_SUFFIXES = (".gguf", ".json")
ARTIFACT_URL_PREFIX = "/models/"

# Request checks.
REPO_PATTERN = "^[a-zA-Z0-9_-]+/[a-zA-Z0-9_.-]+$"
MAX_FILENAME_LENGTH = 255
QUANTIZATIONS = ("f16", "q8_0", "q5_0", "q4_0")
DEFAULT_QUANTIZATION = "q8_0"
DEFAULT_MODEL = "tuned"
DEFAULT_SOURCE_SPLIT = "train"
MIN_LIMIT, MAX_LIMIT = 0.01, 1.0
DEFAULT_EVALUATE_LIMIT, DEFAULT_JUDGE_LIMIT = 1.0, 0.2
MIN_SHARPNESS, MAX_SHARPNESS, DEFAULT_SHARPNESS = 0, 100, 50
MAX_VARIATIONS = 50

# Files to evaluate on, best first.
TEST_SETS = ("val.jsonl", "dataset.jsonl")

# Judge: sharpness below 30 is lenient, above 70 strict, otherwise balanced.
LENIENT_BELOW, STRICT_ABOVE = 30, 70
LENIENT = (
    "You are a lenient judge. Focus on creativity and flow. Even if the output deviates from "
    "the target, if it makes sense and is coherent, give it a high score."
)
STRICT = (
    "You are a specific and strict judge. The output must closely match the target in style, "
    "tone, and content. Penalize deviations heavily."
)
BALANCED = (
    "You are a balanced judge. Look for correct information and similar tone. Minor deviations "
    "are acceptable."
)
JUDGE_TEMPLATE = """
        {instruction}

        Task: Rate the AI Model output on a scale of 0 to 10 (10 being perfect).

        Input Prompt: "{input}"

        Expected Target: "{target}"

        Actual Model Output: "{output}"

        Format your response as a JSON object: {{"score": <number>, "reason": "<short explanation>"}}
        RETURN ONLY JSON."""
JUDGE_TEMPERATURE = 0.1
JUDGE_FAILED = "Judge Failed"

# Variations of a seed example.
VARIATION_TEMPLATE = """You are a synthetic data generator.
    I will provide a "Seed Example" of an Input/Output pair.
    Your task is to generate {count} distinct variations of this example.

    Seed Input: "{seed_input}"
    Seed Output: "{seed_output}"

    Output format: JSON array of objects with "input" and "target" keys.
    Example: [{{"input": "...", "target": "..."}}, ...]
    RETURN ONLY JSON."""
VARIATION_TEMPERATURE = 0.8
FENCES = ("```json", "```python", "```")
COMPLETION_TIMEOUT_SECONDS = 300

# Monitoring and catalogue.
LOG_TEXT_LENGTH = 500
LOG_TAIL = 101
BYTES_PER_MB = 1024 * 1024
HISTORY_LENGTH = 20
SEARCH_TAG = "text-generation"
DEFAULT_SEARCH_LIMIT, MAX_SEARCH_LIMIT = 20, 100
