"""clusterscope — grouped site search as Spark DataFrame jobs.

Pages in, labelled and ranked groups of search hits out.  Every operator is a
function ``DataFrame(s) -> DataFrame``; nothing is collected to the driver
except bounded, checked-size lookup tables.
"""

__version__ = "0.1.0"
