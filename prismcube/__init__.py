"""prismcube: a rollup-cube query engine for event tables on Spark."""
