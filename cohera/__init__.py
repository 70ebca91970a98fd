"""cohera: Spark-native jobs for discourse-coherence and review-text datasets.

Every operator is a function ``DataFrame -> DataFrame`` built from Spark SQL
expressions; random choices are md5 ranks of ``(seed, key...)`` so results do
not depend on partitioning and can be checked against plain SQL.
"""

__version__ = "0.1.0"
