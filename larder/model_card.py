"""What labels sentences here, and how well it is known to."""

from __future__ import annotations

import sys

CARD = """\
# English labelling

Without weights: a rule tagger for parts of speech and a chain of hand-set weights. It knows units, numbers, sizes,
punctuation and common preparations, takes the words before the first comma for one name and the rest for comment.
No accuracy is claimed for it.

With weights: `Models.from_directory(folder)` loads a perceptron tagger, tag overrides and a quantised chain. Path search and
marginals are exact given these; nothing here has been measured with them.
"""


def show_model_card(lang: str = "en") -> None:
    from .plans.parse import check_options

    check_options(None, lang)
    sys.stdout.write(CARD)
