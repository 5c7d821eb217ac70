"""Element locators for stored web pages, and text operators, on Spark."""
