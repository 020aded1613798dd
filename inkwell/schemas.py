"""Schemas of the main tables. Numbers that come as text keep the text; missing values are 'N/A' there."""

LICENCE = "file_loc string, journal_name string, pmcid string, modified_date string, pmid string, license_type string"
PAPER_INFO = "pmcid string, title string, journal string, journal_abbrev string, year string, month string, day string, cited_times int"
PUBMED = "pmid string, journal string, journal_abbrev string, num_cited int, title string, abstract string, year string, month string, day string"
GROUP = ("_index string, PMCID string, title string, journal string, year string, cited_times int, number_of_words int, doc_id long, "
         "sent_id int, section string, content string, num_group int")
GRAMS = "n int, gram string, cnt long"
LUT = "word string, vec array<float>"
PROFILE = "profileID string, text map<string,string>, figures map<string,struct<data:binary,contentType:string>>, updated timestamp"
EDGES = "src string, dst string, link_type string"
