"""Deterministic stage functions. They are nested, so workers need no import of this module."""


def lead_summary():
    """Summary of the first words of the article part of the prompt; some texts fail."""
    def run(prompts):
        answers = []
        for prompt in prompts:
            text = prompt.split("Article:\n", 1)[1]
            if "boom" in text:
                raise RuntimeError("no answer")
            answers.append("short" if "tiny" in text else "**Lead** " + " ".join(text.split()[:20]))
        return answers

    return run


def keyword_label():
    """Label by a word of the summary."""
    def run(prompts):
        answers = []
        for prompt in prompts:
            summary = prompt.split("Summary:\n", 1)[1]
            answers.append(" Cybersecurity\n" if "breach" in summary else KeyError("k") if "odd" in summary else "Other")
        return answers

    return run
