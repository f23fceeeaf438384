"""Text knowledge graphs on Spark, and operators for training data."""

import os

# The driver forks to start Spark, after which threads of numpy's linear algebra may wait for ever; workers
# have one thread a task anyway. Holds where numpy is not loaded yet; driver-side code keeps clear of them besides.
os.environ.setdefault("OPENBLAS_NUM_THREADS", "1")
