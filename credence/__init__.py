"""credence: review-credibility analytics as Spark DataFrame transforms.

Every public function is ``DataFrame -> DataFrame`` or ``Column -> Column``.
Nothing in the library collects an unbounded result to the driver; the only
driver round trip is the size-checked product block broadcast of the top-k
similarity join (see ``credence.operators.retrieval``).
"""

__version__ = "0.1.0"
